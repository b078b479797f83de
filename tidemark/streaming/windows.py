"""Streaming twins of the batch operators, over a file source.

Times without zone are read as UTC. Lateness of an hour is our bound; the batch twins have none.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.states import LEVELS, next_level
from ..sources.tables import epoch_us

LATE = "1 hour"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` files as they arrive, with an event time that takes a watermark."""
    schema = spark.read.parquet(folder).schema
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withColumn("at", F.timestamp_micros(epoch_us())).withWatermark("at", LATE)


def minute_medians(stream: DataFrame) -> DataFrame:
    """One row per type and minute with the median of what was measured."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return stream.groupBy("event_type", F.window("at", "1 minute")).agg(F.percentile(cents, F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n"))


def rain_windows(stream: DataFrame) -> DataFrame:
    """Tips of the last ten minutes, every minute."""
    return stream.where("event_type = 'click'").groupBy(F.window("at", "10 minutes", "1 minute")).agg(F.count(F.lit(1)).alias("tips"))


def first_per_key(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Keep-first within the bound of lateness: a re-delivered row adds none."""
    return stream.dropDuplicatesWithinWatermark(keys)


def level_stream(stream: DataFrame, key: str, ts: str, height: str, rain: str, enter=(30.0, 60.0), leave=(25.0, 55.0), rains=(10.0, 30.0), dwell: float = 60.0, forget_s: float | None = None) -> DataFrame:
    """The level machine with its state (level, start of the calm spell) kept per key; with ``forget_s`` a key that has sent nothing for so long by the wall clock is forgotten."""

    def run(keys, batches: Iterator, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        now, low = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        out = []
        for t, h, r in zip(rows[ts], rows[height], rows[rain], strict=True):
            now, low = next_level(now, low, t, None if pd.isna(h) else h, None if pd.isna(r) else r, enter, leave, rains, dwell)
            out.append(LEVELS[now])
        state.update((now, low))
        if forget_s:
            state.setTimeoutDuration(int(forget_s * 1000))
        yield pd.DataFrame({key: keys[0], ts: rows[ts].to_numpy(), "level": out})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {ts} double, level string", "now int, low double", "append", "ProcessingTimeTimeout" if forget_s else "NoTimeout")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and give what it wrote."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
