"""Small cases with known answers."""

from pyspark.sql import functions as F

from tidemark.functions.hydraulics import afflux_ratio, blockage_factor, critical_bf
from tidemark.operators import states, timeseries as ts
from tidemark.sources import sensor_csv


def test_median_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1, 0.4), ("a", 2, 0.5), ("a", 3, 0.6), ("a", 4, None)], "k string, t int, v double")
    out = ts.rolling_nonnull(df, "k", ["t"], "v", 5, "m").orderBy("t").collect()
    assert [r["m"] for r in out] == [0.4, 0.45, 0.5, 0.5]


def test_growth_needs_time(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 60.0, 0.25), ("a", 120.0, None)], "k string, t double, v double")
    assert [r["growth_per_min"] for r in ts.growth(df, "k", "t", "v", 300).orderBy("t").collect()] == [None, 0.25, None]


def test_streak_resets(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.9, 0.9, 0.0, 0.9, None])], "k string, t int, v double")
    assert [r["streak"] for r in ts.streak(df, "k", ["t"], F.col("v") > 0.3).orderBy("t").collect()] == [1, 2, 0, 1, 0]


def test_nearest_keeps_first_of_equals_and_unmatched(spark):
    left = spark.createDataFrame([(1, 1050), (2, 5000), (3, 1060)], "l int, lt int")
    right = spark.createDataFrame([(1, 1040), (2, 1060), (3, 1000)], "r int, rt int")
    got = {r["l"]: r["rt"] for r in ts.nearest(left, right, "lt", "rt", "r", 60).collect()}
    assert got == {1: 1040, 2: None, 3: 1060}


def test_bad_line_rejects_its_batch(spark):
    good = "t,5,1.5,nan,1,5,,0,,AMAN,0,ntp,-60,"
    df = spark.createDataFrame([(1, good), (1, "a,b"), (2, good), (2, ""), (2, "ts_utc,x")], "batch_id int, csv string")
    out = sensor_csv.accepted(sensor_csv.parse(df)).collect()
    assert [(r["batch_id"], r["jarak_cm"], r["tinggi_cm"], r["sms_status"]) for r in out] == [(2, 1.5, None, None)]


def test_level_rises_at_once_and_falls_after_dwell(spark):
    heights = [(0, 10.0), (1, 31.0), (2, 61.0), (3, 50.0), (40, 50.0), (70, 50.0), (71, None), (80, 20.0), (150, 20.0)]
    df = spark.createDataFrame([("a", float(t), h, 0.0) for t, h in heights], "k string, t double, h double, r double")
    out = [r["level"] for r in states.levels(df, "k", "t", "h", "r").orderBy("t").collect()]
    assert out == ["AMAN", "WASPADA", "BAHAYA", "BAHAYA", "BAHAYA", "WASPADA", "WASPADA", "WASPADA", "AMAN"]


def test_hydraulics(spark):
    row = spark.range(1).select(
        afflux_ratio(F.lit(0.5)).alias("half"), afflux_ratio(F.lit(0.85)).alias("beyond"), F.round(blockage_factor(F.lit(0.24), 1.3, 0.02), 6).alias("bf"),
        blockage_factor(F.lit(None).cast("double")).alias("none"), critical_bf(F.lit(0.8), F.lit(1.6)).alias("critical"),
    ).first()
    assert (row["half"], row["beyond"], row["bf"], row["none"]) == (4.0, None, 0.332, None)
    assert abs(row["critical"] - (1 - 0.5**0.5)) < 1e-12


def test_no_split_is_empty(spark):
    for n in (3, 4, 6, 7, 10):
        df = spark.createDataFrame([("d", f"g{i}", 10) for i in range(n)], "d string, g string, n int")
        assert {r["split"] for r in states.greedy_split(df, "d", "g", "n").collect()} == {"train", "val", "test"}
