"""Tables of a folder, and the observation series that ``events`` stands in for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(ts: str = "ts"):
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, seq, ts_s (double seconds) and frac: share of 500, null where the event is an error (not measured)."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("site"),
        F.col("event_id").alias("seq"),
        F.col("event_type"),
        (F.floor(epoch_us() / 1000000)).cast("double").alias("ts_s"),
        F.when(F.col("event_type") != "error", F.least(F.lit(1.0), cents / F.lit(50000.0))).alias("frac"),
    )


#: The same series in DuckDB.
OBSERVATIONS_SQL = """
obs AS (
  SELECT user_id AS site, event_id AS seq, event_type, floor(epoch_us(ts) / 1000000.0)::DOUBLE AS ts_s,
    CASE WHEN event_type <> 'error' THEN least(1.0, round(value * 100)::BIGINT / 50000.0::DOUBLE) END AS frac
  FROM events
)"""
