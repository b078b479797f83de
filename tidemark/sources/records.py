"""Readers of delivered batches, line-wise metadata, reviews, settings and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.validation import VERDICTS
from . import sensor_csv

ENVELOPE = "device string, rows array<struct<csv:string>>"
META = "sample_id string, dataset string, image string, mask string, `group` string, width int, height int, clump_heuristic boolean"
PSEUDOLABEL = "sample_id string, sam_score double, water_frac double, auto_flag string"
RUN_FILE = r"([^/]+)/([^/]+)$"


def envelopes(bodies: DataFrame, body: str = "value", batch: str = "batch_id") -> DataFrame:
    """The lines of delivered batches (``batch``, JSON ``body``): batch, device, pos, csv and what ``sensor_csv.parse`` gives, with ``accepted``.

    A batch is accepted as a whole or not at all: its body must be an envelope with a device and a list of rows, and all
    its lines well formed. A batch whose list is empty is accepted and has no rows; one that is no envelope has one row
    of nulls.
    """
    read = bodies.select(batch, F.from_json(F.col(body), ENVELOPE).alias("e"))
    shaped = F.coalesce(F.trim("e.device") != "", F.lit(False)) & F.col("e.rows").isNotNull()
    rows = read.select(batch, F.trim("e.device").alias("device"), shaped.alias("__shaped"), F.posexplode_outer("e.rows").alias("pos", "__row")).where("NOT __shaped OR pos IS NOT NULL")
    lines = rows.select(batch, "device", "__shaped", "pos", F.col("__row.csv").alias("csv"))
    known = sensor_csv.parse(lines.where("__shaped AND csv IS NOT NULL"))
    broken = lines.where("NOT __shaped OR csv IS NULL").withColumn("ok", F.lit(False))
    every = known.unionByName(broken, allowMissingColumns=True)
    return every.withColumn("accepted", F.bool_and(F.col("ok") & F.col("__shaped")).over(Window.partitionBy(batch))).drop("__shaped")


def quarantined(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of accepted batches, rows of the others, for a sink of their own)."""
    return parsed.where("accepted").drop("accepted", "ok"), parsed.where("NOT accepted")


def json_lines(spark: SparkSession, path: str, schema: str = META) -> DataFrame:
    """One record per line; a line that is none fails the query that reads it."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def verdicts(spark: SparkSession, path: str, id_col: str = "sample_id", value: str = "verdict") -> DataFrame:
    """Reviews (id, verdict) of a CSV file with a header; a verdict that is none fails the query with its line.

    Lines are counted from 2, the one after the header; lines within quotes are not broken.
    """
    lines = spark.read.option("header", True).option("quote", '"').csv(path, enforceSchema=False)
    if id_col not in lines.columns or value not in lines.columns:
        raise ValueError(f"{path} lacks a column {id_col} or {value}")
    numbered = lines.select(F.col(id_col), F.lower(F.trim(F.coalesce(value, F.lit("")))).alias(value), F.monotonically_increasing_id().alias("__n"))
    part, at = F.shiftright("__n", 33), F.col("__n").bitwiseAND((1 << 33) - 1)
    where = F.concat(F.when(part == 0, F.concat(F.lit("line "), (at + 2).cast("string"))).otherwise(F.concat(F.lit("part "), part.cast("string"), F.lit(" line "), (at + 1).cast("string"))))
    checked = F.when(F.col(value).isin(*VERDICTS), F.col(value)).otherwise(F.raise_error(F.concat(where, F.lit(": no verdict: "), F.col(value))).cast("string"))
    return numbered.select(id_col, checked.alias(value))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, bytes and time of all files below a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def runs(spark: SparkSession, folder: str, pattern: str = "*.pt") -> DataFrame:
    """Each run's newest file that matches: run, path, modified; newest first."""
    files = listing(spark, folder, pattern).withColumn("run", F.regexp_extract("path", RUN_FILE, 1))
    newest = files.groupBy("run").agg(F.max_by(F.struct("path", "modified"), F.struct("modified", "path")).alias("m"))
    return newest.select("run", "m.*").orderBy(F.desc("modified"), "run")


def control(spark: SparkSession, path: str, schema: str, valid: Column | None = None) -> DataFrame:
    """The record of a small control file, no row if it is missing, broken or not ``valid``. Read it anew at every poll."""
    from .sinks import exists

    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, __bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    fine = rows.where("__bad IS NULL").drop("__bad")
    return fine if valid is None else fine.where(F.coalesce(valid, F.lit(False)))


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON file of one document or a list of them: settings, class schemas, benchmark results."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def settings(spark: SparkSession, path: str, needed: tuple[str, ...] = ()) -> dict:
    """A settings file as a dictionary; a name of ``needed`` that it lacks is an error."""
    made = json_document(spark, path).first()
    out = made.asDict(recursive=True) if made else {}
    lacking = [n for n in needed if out.get(n) is None]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    return out


def first_value(spark: SparkSession, path: str, names: tuple[str, ...] = ("model name", "Model")) -> DataFrame:
    """The text after the colon of the first line that begins with one of ``names``; no row if none does."""
    lines = spark.read.text(path).withColumn("__n", F.monotonically_increasing_id())
    begins = F.lit(False)
    for n in names:
        begins = begins | F.col("value").startswith(n)
    return lines.where(begins).orderBy("__n").limit(1).select(F.trim(F.regexp_replace("value", r"^[^:]*:?", "")).alias("value"))


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, without rows if it is not there yet."""
    from .sinks import exists

    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
