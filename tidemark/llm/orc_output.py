"""Token-id files: ORC stripes with run-length encoded ids, row indexes and Bloom filters on the document id.

``write_ids`` lays the documents out by ranges of their id, so that a stripe's statistics cover a narrow range;
readers take stripes in parallel and skip those whose indexes or Bloom filters exclude a document.

Defined results: null and empty texts hold the end id alone; rows that repeat a document id stay side by side, in the
order of their texts' hashes; null ids come first; an empty table gives files without rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch

FILE_SCHEMA = "doc_id long, ids array<int>, n_tokens long, part int, salt long"
#: UTF-8 bytes of text that one file holds, about.
FILE_BYTES = 64 << 20
STRIPE_BYTES = 16 << 20


def _encode(path: str, end: int):
    def run(batches):
        import pyarrow as pa

        from .common import string_parts, text_slices
        from .tokens import encoder_for, with_end

        encoder = encoder_for(path)
        for batch in batches:
            for part in text_slices(batch, 1):
                ids, counts = encoder(*string_parts(part.column(1)))
                ids, bounds = with_end(ids, counts, end)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype("int32")), pa.array(ids.view("int32")))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(counts + 1), part.column(2), part.column(3)], ["doc_id", "ids", "n_tokens", "part", "salt"])

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = 0, files: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text), append ``end`` to each and write them as ORC in ascending doc_id order.

    ``part`` numbers the files in that order; within a file rows are sorted too.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    if files is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, -(-size // FILE_BYTES))
    # the salt lets a range of one much repeated id spread over files
    laid = rows.withColumn("salt", F.xxhash64("text")).repartitionByRange(files, "doc_id", "salt").sortWithinPartitions("doc_id", "salt")
    laid = laid.select("doc_id", "text", F.spark_partition_id().alias("part"), "salt")
    (
        laid.mapInArrow(_encode(tokenizer, end), FILE_SCHEMA)
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", 1000)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The written documents; filters on doc_id reach the stripes' indexes and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def _digest(batches):
    import zlib

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lists = batch.column(1)
        at = lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).view("uint8"))
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(at).astype("int64")), pa.array(sums, pa.int64())], ["doc_id", "part", "salt", "n_tokens", "ids_crc32"])


def file_digests(ids: DataFrame) -> DataFrame:
    """Per document of read files: its first id's position among all documents, its number of ids and their CRC-32."""
    sums = ids.select("doc_id", "ids", "part", "salt").mapInArrow(_digest, "doc_id long, part int, salt long, n_tokens long, ids_crc32 long")
    each = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "salt", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file; the running sum over files is over that many rows only
    files = ids.groupBy("part").agg(F.sum("n_tokens").alias("file_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("base"))
    return sums.join(files, "part").select("doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(each), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def op9_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    path = f"{scratch(spark)}/tidemark-orc-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return file_digests(read_ids(spark, path))
