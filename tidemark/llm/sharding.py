"""Rendezvous hashing of stable record keys over weighted shards.

Every record scores every shard by a hash of (key, shard) scaled by the shard's weight, and goes to the best. A new
shard takes exactly the records that score it best; no record moves between old shards.

Defined results: a null key hashes as itself, so all null keys share a shard; rows that repeat a key share its shard;
a null text is 16 bytes; of equal scores the smaller shard wins; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets_for, staged, table, text_of

SHARDS = 40
#: Rows of a shard that are numbered together, about.
NUMBERED = 50_000


def _score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight for a u in (0, 1) drawn by key and shard; the least wins."""
    if weight <= 0:
        raise ValueError("weights are positive")
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(weight))


def _best(key: Column, weights: Sequence[float]) -> Column:
    scores = [F.struct(_score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.least(*scores) if len(scores) > 1 else scores[0]


def assigned(rows: DataFrame, key: str, weights: Sequence[float], grown: float | None = 1.0) -> DataFrame:
    """``rows`` with ``shard`` and, if one more shard of weight ``grown`` came, ``grown_shard``."""
    out = rows.withColumn("__best", _best(F.col(key), weights))
    more = F.lit(None).cast("int")
    if grown is not None:
        more = F.when(_score(F.col(key), len(weights), grown) < F.col("__best.score"), F.lit(len(weights))).otherwise(F.col("__best.shard"))
    return out.select(*(F.col(c) for c in rows.columns), F.col("__best.shard").alias("shard"), more.cast("int").alias("grown_shard"))


def numbered(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """``rows`` (with ``shard``) with ``slot``: 0, 1, 2, ... within each shard.

    A shard is numbered in parts by a hash of the whole row, so that neither a shard nor a key that many different rows
    share lands in one task; the sizes of the parts, a row each, tell where each part begins.
    """
    rows = staged(rows, "shards")
    parts = buckets_for(rows.count(), NUMBERED * shards, least=8)
    laid = rows.withColumn("__part", F.pmod(F.xxhash64(*(c for c in rows.columns if c != "shard"), F.lit("part")), F.lit(parts)).cast("int"))
    sizes = laid.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"))
    inside = Window.partitionBy("shard", "__part").orderBy(F.col(key).asc_nulls_first(), *(c for c in rows.columns if c not in (key, "shard")))
    made = laid.withColumn("__at", F.row_number().over(inside)).join(begins, ["shard", "__part"])
    return made.select(*rows.columns, (F.col("__begin") + F.col("__at") - 1).cast("long").alias("slot"))


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    laid = numbered(assigned(rows, "doc_id", [1.0] * SHARDS), "doc_id", SHARDS)
    return laid.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
