"""Global order of any type, percentiles by selection, reviews, sensor lines and states on odd rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import evaluation, order, ranks, splits, states, validation
from tidemark.sources import records, sensor_csv, sinks


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, "x", "é", "xx", f"id-{rng.randrange(50)}"]), rng.choice([None, rng.random()])) for _ in range(400)]
    return data, spark.createDataFrame(data, "g string, id string, v double")


def key(*values):
    return tuple((v is not None, v.encode() if isinstance(v, str) else v or 0) for v in values)


@pytest.mark.parametrize("ranges", [None, 7])
def test_places_follow_any_type(rows, ranges):
    data, df = rows
    got = sorted(order.placed(df, ["g", F.desc("id")], ranges=ranges).collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in got] == list(range(1, len(data) + 1))
    groups = [r["g"] for r in got]
    assert groups == sorted(groups, key=key)
    for g in {d[0] for d in data}:
        mine = [r["id"] for r in got if r["g"] == g]
        assert [x or "" for x in mine] == sorted((x or "" for x in mine), key=str.encode, reverse=True)


def test_places_within_groups(rows, monkeypatch):
    data, df = rows
    for most in (order.SENT_GROUPS, 0):
        monkeypatch.setattr(order, "SENT_GROUPS", most)
        got = order.numbered(df, ["g"], ["id", "v"], ranges=5).collect()
        for g in {d[0] for d in data}:
            mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["at"])
            assert [r["at"] for r in mine] == list(range(1, len(mine) + 1)) and {r["n"] for r in mine} == {len(mine)}
            assert [(r["id"], r["v"]) for r in mine] == sorted(((d[1], d[2]) for d in data if d[0] == g), key=lambda d: key(*d))


def test_samples_are_capped_after_the_stride(spark):
    ten = spark.createDataFrame([("s", f"k{i}") for i in range(10)], "g string, k string")
    assert [r["k"] for r in splits.every_kth(ten, ["g"], ["k"], 3, 4).orderBy("k").collect()] == ["k0", "k3", "k6", "k9"]
    assert splits.every_kth(ten, ["g"], ["k"], 3, 2).count() == 2
    assert [r["k"] for r in splits.checked_sample(ten, ["g"], ["k"], 4).orderBy("k").collect()] == ["k0", "k2", "k4", "k6"]
    assert splits.checked_sample(ten, ["g"], ["k"], 10).count() == 10
    drawn = splits.capped(ten, "g", "k", F.col("n") * 0.5, 7)
    assert drawn.count() == 5 and drawn.distinct().count() == 5
    assert splits.capped(ten.where("false"), "g", "k", F.lit(3), 7).count() == 0


@pytest.mark.parametrize("ranges", [None, 9])
def test_percentiles_by_selection(rows, ranges):
    data, df = rows
    shares = {"p0": 0.0, "p10": 0.1, "med": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: r for r in ranks.percentiles(df, ["g"], "v", shares, ranges).collect()}
    want = {r["g"]: r for r in df.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in shares.items()], F.count("v").alias("n")).collect()}
    assert {g: tuple(r[n] for n in (*shares, "n")) for g, r in got.items()} == {g: tuple(r[n] for n in (*shares, "n")) for g, r in want.items()}
    for r in evaluation.video_summary(df, ["g"], "v").collect():
        mine = [d[2] for d in data if d[0] == r["g"]]
        assert r["med"] == pytest.approx(statistics.median(v for v in mine if v is not None)) and r["unmeasurable"] == mine.count(None)


def test_a_group_that_was_never_measured_has_no_median(spark):
    row = evaluation.video_summary(spark.createDataFrame([("a", None)], "g string, v double"), ["g"], "v").first()
    assert (row["med"], row["unmeasurable"]) == (None, 1)


def test_review_loop(spark, tmp_path):
    data = [("clip-b", "", 0.9, 0.3), ("clip-a", "low_score", 0.3, 0.1), ("x__1", "too_small", 0.2, None), ("x__0", "", None, 0.2)]
    df = spark.createDataFrame(data, "sample_id string, auto_flag string, sam_score double, water_frac double")
    assert [r["sample_id"] for r in validation.worst_first(df, F.col("auto_flag") != "", "sam_score", "sample_id").orderBy("pos").collect()] == ["x__1", "clip-a", "x__0", "clip-b"]
    path = str(tmp_path / "review")
    sinks.write_review(df, path, "auto_flag", "sam_score", "sample_id", ["water_frac", "sam_score"])
    made = [tuple(r) for r in spark.read.option("header", True).csv(path).fillna("").collect()]
    assert made == [("x__1", "", "auto:too_small water_frac=- sam_score=0.2"), ("clip-a", "", "auto:low_score water_frac=0.1 sam_score=0.3"), ("x__0", "ok", ""), ("clip-b", "ok", "")]
    counts = {r["verdict"]: r["n"] for r in sinks.apply_review(spark, path, str(tmp_path / "excluded")).collect()}
    assert counts == {"unreviewed": 2, "ok": 2}
    assert [r["value"] for r in spark.read.text(str(tmp_path / "excluded")).collect()] == ["clip-a", "x__1"]
    (tmp_path / "bad.csv").write_text("file,verdict\na,ok\nb,maybe\n")
    with pytest.raises(Exception, match="line 3"):
        records.verdicts(spark, str(tmp_path / "bad.csv"), "file").collect()


GOOD = "2024-01-31T08:36:26Z,1706690186,12.5,30,1,5,10,0,0.5,AMAN,0,ntp,-60,ok"


def test_sensor_lines(spark):
    swap = lambda i, v: ",".join(v if k == i else x for k, x in enumerate(GOOD.split(",")))
    cases = {
        GOOD: True, GOOD + "\r": True, "\t" + GOOD + " \r\n": True, swap(13, " ok\r"): True, swap(2, "nan"): True, swap(2, "-NaN"): True, swap(3, ""): True, swap(3, " 1e2 "): True, swap(12, "-.5"): True,
        swap(0, ""): False, swap(0, " "): False, swap(1, "nan"): False, swap(1, ""): False, swap(1, "x"): False, swap(2, "12d"): False, swap(2, "1f"): False, swap(2, "inf"): False, swap(2, "1 2"): False, swap(2, "1e999"): False, "a,b,c": False,
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, csv string")
    got = {r["i"]: r for r in sensor_csv.parse(df).collect()}
    assert {c: got[i]["ok"] for i, c in enumerate(cases)} == cases
    first = got[1]
    assert (first["ts_epoch"], first["jarak_cm"], first["rssi"], first["sms_status"]) == (1706690186, 12.5, -60, "ok")
    skipped = spark.createDataFrame([(c,) for c in ("", " ", "\r", "\t", "ts_utc,ts_epoch", " ts_utc\r", None)], "csv string")
    assert sensor_csv.parse(skipped).count() == 0


def test_absent_classes_have_no_scores(spark):
    matrix = spark.createDataFrame([(0, 0, 5), (0, 1, 2)], "t int, p int, n long")
    got = {r["cls"]: (r["iou"], r["prec"], r["rec"]) for r in evaluation.class_scores(matrix, "t", "p", [0, 1, 2]).collect()}
    assert got[2] == (None, None, None) and got[1] == (0.0, 0.0, 0.0)


BIG = [2**53 + 1, 2**53 + 3, -(2**63), None]


def test_ids_survive_states(spark):
    df = spark.createDataFrame([(k, float(i), 70.0 if i % 2 else None, None) for k in BIG for i in range(3)], "k long, t double, h double, r double").coalesce(1)
    made = states.levels(df, "k", "t", "h", "r").collect()
    assert sorted(map(str, {r["k"] for r in made})) == sorted(map(str, BIG)) and all(r["level"] == ("AMAN" if r["t"] == 0 else "BAHAYA") for r in made)
    kept = states.throttled(df, "k", "t", 2.0).collect()
    assert sorted(str(r["k"]) for r in kept) == sorted(str(k) for k in BIG for _ in range(2))
    groups = spark.createDataFrame([("d", k, 5) for k in BIG], "d string, g long, n int")
    assert sorted(str(r["g"]) for r in states.greedy_split(groups, "d", "g", "n").collect()) == sorted(map(str, BIG))


def test_times_with_an_offset(spark):
    texts = ["2026-08-22T21:00+07:00", "2026-08-22T14:00", "2026-08-22 14:00:00Z", "2026-08-22T09:30:00.000-04:30", "junk", "2026-08-22T14:00+7"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_timestamp(labels.parse_utc(F.col("t")))).collect()]
    assert got == [1787407200] * 4 + [None, None]
