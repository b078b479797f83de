"""Scans in two levels give the rows of one window over the whole key."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scans
from tidemark.operators import timeseries as ts


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), float(t), i, None if rng.random() < 0.3 else rng.random()) for i, t in enumerate(rng.sample(range(5000), 600))]
    return spark.createDataFrame(rows, "k string, ts double, seq long, v double").cache()


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("width", [7.0, 100.0, float("inf")])
def test_equal_to_one_window(series, width):
    order = ["ts", "seq"]
    for how in ("median", "mean"):
        assert rows(ts.rolling_nonnull(series, "k", order, "v", 5, "o", how, width)) == rows(ts.rolling_nonnull(series, "k", order, "v", 5, "o", how))
    assert rows(ts.growth(series, "k", "ts", "v", 60, width=width)) == rows(ts.growth(series, "k", "ts", "v", 60))
    assert rows(ts.streak(series, "k", order, F.col("v") > 0.3, width=width)) == rows(ts.streak(series, "k", order, F.col("v") > 0.3))
    assert rows(ts.carried(series, "k", order, F.col("v"), "ts", "c", "age", width)) == rows(ts.carried(series, "k", order, F.col("v"), "ts", "c", "age"))
    assert rows(ts.segments(series, "k", order, F.col("v") > 0.8, width=width)) == rows(ts.segments(series, "k", order, F.col("v") > 0.8))


def test_alerts_by_buckets(series):
    made = [ts.alerts(series.withColumn("g", F.col("v") / 2), "k", ["ts", "seq"], "v", "g", 0.5, 0.4, 3, width) for width in (None, 50.0)]
    assert rows(made[0].select(sorted(made[0].columns))) == rows(made[1].select(sorted(made[0].columns)))


def test_frames_of_values_are_dealt_over_tasks(series):
    small = scans.rolling(series, ["k"], ["ts", "seq"], "v", 5, F.max, 100.0, "o", size=16)
    assert rows(small) == rows(scans.rolling(series, ["k"], ["ts", "seq"], "v", 5, F.max, 100.0, "o"))


def test_odd_series(series):
    spark = series.sparkSession
    none = series.where("false")
    assert ts.streak(none, "k", ["ts", "seq"], F.col("v") > 0, width=5.0).count() == 0
    assert scans.width_for(none, ["k"], "ts") == float("inf")
    odd = spark.createDataFrame([("a", None, 1, 1.0), ("a", None, 2, None), ("a", -3.0, 3, 2.0), (None, 4.0, 4, 3.0)], "k string, ts double, seq long, v double")
    got = {r["seq"]: r["c"] for r in ts.carried(odd, "k", ["ts", "seq"], F.col("v"), "ts", "c", "age", 2.0).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 2.0, 4: 3.0}


def test_a_bucket_holds_about_the_rows_wanted(spark):
    rows_ = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("ts"))
    assert 40 <= scans.width_for(rows_, ["k"], "ts", 50) <= 60


def test_values_before_a_row(series):
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    want = series.withColumns({"a": F.sum("v").over(w).cast("decimal(9,4)"), "b": F.max("v").over(w)})
    got = scans.running(series, ["k"], ["ts", "seq"], 60.0, a=("sum_before", F.col("v")), b=("max_before", F.col("v")))
    assert rows(got.withColumn("a", F.col("a").cast("decimal(9,4)"))) == rows(want)


def test_growth_sends_and_sorts_rows_once(spark):
    series = spark.range(50).selectExpr("id % 2 AS k", "CAST(id AS double) AS ts", "id / 50 AS v")
    plan = ts.growth(series, "k", "ts", "v", 5, width=10.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
