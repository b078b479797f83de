"""Clocks in state: silence by the wall clock, samples by several clocks, nearest rows of two streams."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import states
from tidemark.operators import timeseries as ts
from tidemark.streaming import monitors, timers, windows


def put(spark, rows, schema, folder, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(str(folder))


def waited(until, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if until():
            return True
        time.sleep(0.5)
    return False


def test_silence_of_all_sources_and_restart(spark, tmp_path):
    schema, now = "k string, at timestamp", time.time()
    at = lambda s: F.timestamp_seconds(F.lit(now + s))
    for k, s in (("a", 0.0), ("b", 1.0), (None, 0.0)):
        spark.range(1).select(F.lit(k).cast("string").alias("k"), at(s).alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run():
        made = timers.quiet(stream, "k", minutes=0.05, forget_minutes=0.25)
        return made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()

    told = lambda: sorted((r["k"] or "", round(r["quiet_since"].timestamp() - now)) for r in spark.read.schema("k string, quiet_since timestamp").parquet(str(tmp_path / "out")).collect()) if (tmp_path / "out").exists() else []
    query = run()
    try:
        assert waited(lambda: len(told()) == 3)  # nobody sends anything, and all are told of
    finally:
        query.stop()
    assert told() == [("", 0), ("a", 0), ("b", 1)]
    spark.range(1).select(F.lit("a").alias("k"), F.timestamp_seconds(F.lit(time.time())).alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = run()  # from the checkpoint: what was told is not told again, what comes is
    try:
        assert waited(lambda: len(told()) == 4) and [k for k, _ in told()].count("a") == 2
        # a source that stays away is forgotten
        rows = lambda: sum(p.numRowsTotal for p in (query.recentProgress[-1].stateOperators if query.recentProgress else []))
        assert waited(lambda: rows() == 0)
    finally:
        query.stop()
    with pytest.raises(ValueError, match="after it is reported"):
        timers.quiet(stream, "k", minutes=5, forget_minutes=5)


@pytest.mark.parametrize("files", [1, 4])
def test_several_clocks_equal_batch(spark, tmp_path, files):
    rng, schema, rows, t = random.Random(2), "k string, t double, s long", [], 0.0
    for i in range(120):
        t += rng.choice([0.1, 0.5, 3.0])
        rows.append((rng.choice("ab"), t, 2**53 + i))
    for i in range(files):
        put(spark, rows[i * 120 // files : (i + 1) * 120 // files], schema, tmp_path / "in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    clocks = {"trash": 2.0, "water": 10.0}
    got = windows.drain(timers.clocked(stream, "k", "t", clocks, "s"), str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    batch = spark.createDataFrame(rows, schema)
    for name, seconds in clocks.items():
        want = states.throttled(batch, "k", "t", seconds, "s").collect()
        assert sorted((r["k"], r["t"], r["s"]) for r in got if r["clock"] == name) == sorted((r["k"], r["t"], r["s"]) for r in want)


@pytest.mark.parametrize("files", [1, 3, 9])
def test_nearest_of_streams_equals_batch(spark, tmp_path, files):
    rng = random.Random(files)
    lefts = [(rng.choice(["a", "b", None]), float(1000 + rng.randrange(900)), 2**53 + i) for i in range(90)]
    rights = [(rng.choice(["a", "b", None]), float(1000 + rng.randrange(900)), i, rng.choice([None, rng.random()])) for i in range(60)]
    lefts.sort(key=lambda r: r[1])
    rights.sort(key=lambda r: r[1])
    lschema, rschema = "k string, lt double, l long", "k string, rt double, r long, v double"
    for i in range(files):
        at = lambda rows: [r for r in rows if i * 900 // files <= r[1] - 1000 < (i + 1) * 900 // files]  # noqa: B023, E731
        put(spark, at(lefts), lschema, tmp_path / "l")
        put(spark, at(rights), rschema, tmp_path / "r")
    for name, schema, row in (("l", lschema, ("end", 1e6, -1)), ("r", rschema, ("end", 1e6, -1, None))):
        put(spark, [row], schema, tmp_path / name)  # moves the watermark past all
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    made = timers.nearest_stream(read("l", lschema), read("r", rschema), "k", "lt", "rt", "r", 20, "5 minutes")
    got = windows.drain(made, str(tmp_path / "out"), str(tmp_path / "cp")).where("l >= 0")
    want = ts.nearest(spark.createDataFrame(lefts, lschema).withColumn("k", F.coalesce("k", F.lit("-"))), spark.createDataFrame(rights, rschema).withColumn("k", F.coalesce("k", F.lit("-"))), "lt", "rt", "r", 20, "k")
    plain = lambda df: sorted(tuple(str(v) for v in r) for r in df.withColumn("k", F.coalesce("k", F.lit("-"))).select("k", "lt", "l", "rt", "r", "v").collect())
    assert plain(got) == plain(want)


def test_monitors_forget_sources_that_stay_away(spark, tmp_path):
    schema = "k string, t double, f double, slow double, seg string"
    put(spark, [("a", 1.0, 0.5, None, "s")], schema, tmp_path / "in")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    made = monitors.monitored(stream, "k", "t", "f", "slow", "seg", forget_s=2.0)
    query = made.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    try:
        rows = lambda: sum(p.numRowsTotal for p in (query.recentProgress[-1].stateOperators if query.recentProgress else []))
        assert waited(lambda: rows() == 1) and waited(lambda: rows() == 0)
    finally:
        query.stop()
