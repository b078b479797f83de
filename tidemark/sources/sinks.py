"""Idempotent writers: keep-first inserts, keep-last upserts, one folder of lists per split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import utc_text
from ..operators.validation import worst_first


def insert_new(spark: SparkSession, batch: DataFrame, path: str, keys: list[str], order: list[str]) -> int:
    """Append rows whose key is neither in ``path`` nor earlier in ``batch``; returns how many. Re-delivery adds none.

    What is appended is counted as it is written, so that another writer's rows are not.
    """
    first = batch.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    if exists(spark, path):
        first = first.join(spark.read.schema(batch.schema).parquet(path).select(*keys), keys, "left_anti")
    seen = Observation("inserted")
    first.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both with one row per key: the one with the highest ``version``."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), version).alias("m")).select("m.*")


def write_splits(rows: DataFrame, path: str, split: str = "split", name: str = "id", rows_a_file: int = 5_000_000) -> DataFrame:
    """A folder of text lists per split, in order over its files; returns the summary (split, n).

    Rows are laid out by ranges of (split, name), so that a large split is written by many tasks.
    """
    counts = rows.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    laid = rows.select(split, F.col(name).cast("string").alias("value")).repartitionByRange(max(1, -(-total // rows_a_file)), split, "value").sortWithinPartitions(split, "value")
    laid.write.mode("errorifexists").partitionBy(split).text(path)
    return counts


def append_records(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append to a folder of JSON lines the rows whose key it lacks: a job that was stopped goes on."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = rows.join(spark.read.schema(rows.schema).json(path).select(*keys), keys, "left_anti")
    rows.write.mode("append").json(path)


def append_series(rows: DataFrame, folder: str, columns: Sequence[str], kinds: dict[str, str] | None = None, site: str | None = None) -> None:
    """Append observations in fixed columns to a table and, beside it, to CSV files with a header."""
    made = fixed_columns(rows, columns, kinds, site).cache()
    try:
        made.write.mode("append").parquet(f"{folder}/observations")
        made.write.mode("append").option("header", True).option("emptyValue", "").csv(f"{folder}/timeseries")
    finally:
        made.unpersist()


def series_sink(folder: str, columns: Sequence[str], kinds: dict[str, str] | None = None, site: str | None = None, keys: list[str] | None = None, run: str = "0"):
    """A function for ``foreachBatch`` that writes each batch in fixed columns to a table and to CSV files, with one commit for both.

    A batch goes to folders of its own number, and a manifest of that number is written last: what ``committed`` reads.
    A batch that failed in between is written anew, one that is committed is left alone. ``run`` names the stream whose
    checkpoint counts the batches. With ``keys`` only rows are written that no committed batch has, so that rows
    delivered twice add nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        manifest = f"{folder}/_committed/run={run}/batch={number}"
        if exists(spark, f"{manifest}/_SUCCESS"):
            return
        if keys and exists(spark, f"{folder}/_committed"):
            batch = batch.dropDuplicates(keys).join(committed(spark, folder).select(*keys), keys, "left_anti")
        elif keys:
            batch = batch.dropDuplicates(keys)
        made = fixed_columns(batch, columns, kinds, site)
        table = f"{folder}/observations/run={run}/batch={number}"
        made.write.mode("overwrite").parquet(table)
        written = spark.read.schema(made.schema).parquet(table)  # both hold the same rows, also if the batch is not read alike twice
        written.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{folder}/timeseries/run={run}/batch={number}")
        written.agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").json(manifest)

    return write


def committed(spark: SparkSession, folder: str, part: str = "observations", schema: str | None = None) -> DataFrame:
    """The rows of all committed batches of ``part``, observations or timeseries (CSV, as text unless there is a schema), without the columns run and batch."""
    done = spark.read.schema("n long, run string, batch long").option("basePath", f"{folder}/_committed").json(f"{folder}/_committed").select("run", "batch")
    reader = spark.read.option("basePath", f"{folder}/{part}")
    reader = reader.schema(f"{schema}, run string, batch long") if schema else reader
    rows = reader.parquet(f"{folder}/{part}") if part == "observations" else reader.option("header", True).csv(f"{folder}/{part}")
    mine = rows.withColumns({"run": F.col("run").cast("string"), "batch": F.col("batch").cast("long")})
    return mine.join(done, ["run", "batch"], "left_semi").drop("run", "batch")


def write_table(rows: DataFrame, path: str, order: Sequence[str] = (), mode: str = "append") -> None:
    """A small table as one CSV file with a header (an epoch's scores, a video's coverage); null is an empty field."""
    rows.coalesce(1).sortWithinPartitions(*order or rows.columns[:1]).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def write_review(rows: DataFrame, path: str, flagged: str, score: str, key: str, notes: Sequence[str] = ()) -> None:
    """A list for review (file, verdict, note), worst first, as CSV with a header; a list that is there is left alone and the call fails.

    Rows without a flag are ``ok`` from the start; the verdict of flagged ones is blank, so that someone must look, and
    their note names the flag and the columns of ``notes``. A missing score counts as 0.
    """
    bad = F.coalesce(F.col(flagged), F.lit("")) != ""
    said = [F.concat(F.lit(f" {c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in notes]
    note = F.when(bad, F.concat(F.lit("auto:"), F.col(flagged), *said)).otherwise("")
    listed = rows.select(F.col(key).cast("string").alias("file"), F.when(bad, "").otherwise("ok").alias("verdict"), note.alias("note"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("__score"))
    made = worst_first(listed, F.col("verdict") == "", "__score", "file")
    laid = made.repartitionByRange("pos").sortWithinPartitions("pos").select("file", "verdict", "note")
    laid.write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def apply_review(spark: SparkSession, path: str, excluded_path: str) -> DataFrame:
    """Reads a reviewed list and writes the ids that must not be used, one a line, in order; returns how often each verdict stands.

    A blank verdict is ``unreviewed`` and excludes like ``reject``; a row without an id is passed over; any other verdict
    fails with its line.
    """
    from .records import verdicts

    read = verdicts(spark, path, "file").select(F.trim("file").alias("file"), F.when(F.col("verdict") == "", "unreviewed").otherwise(F.col("verdict")).alias("verdict")).where("file <> ''")
    out = read.where("verdict <> 'ok'").select(F.col("file").alias("value"))
    out.repartitionByRange("value").sortWithinPartitions("value").write.mode("errorifexists").text(excluded_path)
    return read.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def fixed_columns(rows: DataFrame, columns: Sequence[str], kinds: dict[str, str] | None = None, site: str | None = None) -> DataFrame:
    """``rows`` with exactly ``columns``, in order: absent ones null (of ``kinds``), ``site`` overwritten if given, ``ts_utc`` made of ``ts_epoch`` where it lacks, booleans as 0 and 1."""
    have = dict(rows.dtypes)
    out = []
    for c in columns:
        col = F.col(c) if c in have else F.lit(None).cast((kinds or {}).get(c, "string"))
        if c == "ts_utc" and "ts_epoch" in have:
            col = F.coalesce(F.nullif(col, F.lit("")), utc_text(F.col("ts_epoch")))
        if c == "site" and site is not None:
            col = F.lit(site)
        out.append((col.cast("int") if have.get(c) == "boolean" else col).alias(c))
    return rows.select(*out)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
