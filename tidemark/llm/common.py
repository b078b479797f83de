"""Helpers that the corpus operators share: tables, the shared scratch folder, binary columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch, staged  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget(df: DataFrame) -> None:
    """Delete what ``staged`` wrote for ``df``, of which nothing is read any more."""
    spark = df.sparkSession
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_of(col: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def row_hash(col: str = "text") -> Column:
    """Tells texts under one id apart."""
    return F.xxhash64(text_of(col)).alias("row_hash")


#: Rows that are named as gone to every task; more are joined by a shuffle.
SENT_GONE = 1_000_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``gone`` (doc_id, row_hash) names; null ids count as equal.

    ``gone`` is written and counted first: sent to every task if it is short, so that texts stay where they are.
    """
    gone = staged(gone.select(F.col("doc_id").alias("__gone_id"), F.col("row_hash").alias("__gone_hash")).distinct(), "gone")
    if gone.count() <= SENT_GONE:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["__gone_hash"]), "left_anti")


def buckets_for(rows: int, per_bucket: int, least: int = 1) -> int:
    """How many groups keep each near ``per_bucket`` rows, whatever the table's size."""
    return max(least, -(-rows // per_bucket))


def text_slices(batch, column: int, most: int = 1 << 20):
    """An Arrow batch in parts of about ``most`` bytes of text, one row at least, so that what is made of them stays small."""
    import numpy as np

    ends = string_parts(batch.column(column))[1][1:]
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def string_parts(column):
    """(bytes as uint8 array, offsets as int64 array) of an Arrow string column, nulls as empty, without a copy per row."""
    import numpy as np
    import pyarrow as pa

    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if arr.null_count:
        arr = arr.fill_null("" if not pa.types.is_binary(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    offsets = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0]
