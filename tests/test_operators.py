"""Operators on small tables with known answers: nulls, ties, repeats and empty tables among them."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry, hydraulics, labels
from tidemark.operators import evaluation, frames, ranks, splits, states, timeseries as ts, validation


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_labels(spark):
    text = lambda x: F.lit(x).cast("string")
    got = one(
        spark,
        *[F.unix_timestamp(labels.parse_utc(text(x))) for x in ("1970-01-02T00:00:00Z", " 1970-01-02 00:00:00 ", "junk", None)],
        *[labels.due_label(F.lit(h)) for h in (-1.0, 0.001, 0.5, 1.5, 23.4)],
        *[labels.until_label(F.lit(s)) for s in (0, 59, 3599, 5400, 86400, 129600)],
        labels.clock_label(F.timestamp_seconds(F.lit(3661))),
        labels.utc_text(F.lit(86399.9)),
        *[labels.coverage_label(F.lit(x).cast("double")) for x in (0.12345, 0.9999, None)],
        labels.reading(F.lit(2.25), "cm"),
        labels.reading(F.lit(None).cast("double"), "cm"),
        *[labels.forecast_line(F.lit(s), F.lit("Hujan"), F.lit(h).cast("double")) for s, h in (("off", None), ("failed", 1.0), ("ok", None), ("ok", 6.0), ("ok", 7.0))],
    )
    assert list(got)[:4] == [86400, 86400, None, None]
    assert list(got)[4:9] == ["sedang berlangsung", "1 menit lagi", "30 menit lagi", "2 jam lagi", "23 jam lagi"]
    assert list(got)[9:15] == ["sedang berlangsung", "dalam 1 menit", "dalam 60 menit", "dalam 2 jam", "dalam 1 hari", "dalam 2 hari"]
    assert list(got)[15:22] == ["01:01:01", "1970-01-01T23:59:59Z", "12,3%", "100,0%", "tidak terukur", "2,3 cm", "tidak terukur"]
    assert [tuple(x) for x in list(got)[22:]] == [("tidak dipasang", False), ("gagal diambil", False), ("tidak ada hujan", False), ("Hujan 6 jam lagi", True), ("Hujan 7 jam lagi", False)]


def test_lookups_and_guards(spark):
    got = one(spark, labels.looked_up(F.lit("a"), {"a": "x"}, "d"), labels.looked_up(F.lit("b"), {"a": "x"}, "d"), labels.camera_number(F.lit(" 3 ")), labels.camera_number(F.lit("12")), labels.jpeg(F.unhex(F.lit("FFD8FFE0"))), labels.jpeg(F.unhex(F.lit("FFD8FF"))), labels.stale(F.lit(1201)), labels.stale(F.lit(1200)), labels.stale(F.lit(None).cast("int")), labels.looked_up_or_fail(F.lit("a"), {"a": 1}), labels.alert_reason(F.lit(0.5), F.lit(0.2), 0.3, 0.1), labels.alert_reason(F.lit(None).cast("double"), F.lit(0.0), 0.3, 0.1))
    assert list(got) == ["x", "d", 3, None, True, False, True, False, True, 1, "area 0.50 >= 0.3; growth 0.200/min >= 0.1", ""]
    with pytest.raises(Exception, match="unknown class b"):
        one(spark, labels.looked_up_or_fail(F.lit("b"), {"a": 1}))


def test_gate_summary(spark):
    g = one(spark, hydraulics.gate_summary(F.lit(0.5), 1.0, 2.0, 1.5, 0.8), hydraulics.gate_summary(F.lit(None).cast("double"), 1.0, 2.0, 1.5, 0.8), hydraulics.gate_summary(F.lit(0.9), 1.0, 2.0, 1.5, 0.8))
    half, none, beyond = g
    assert (half["afflux_ratio"], half["afflux_m"], half["head_m"], half["margin_m"], len(half)) == (4.0, 3.0, 4.0, -2.0, 12)
    assert math.isclose(half["blocked_discharge"] * 2, half["clear_discharge"]) and math.isclose(half["critical_bf"], 1 - 0.5**0.5)
    assert none["bf"] is None and none["blocked_discharge"] is None and none["clear_discharge"] is not None and none["beyond_model"] is False
    assert beyond["beyond_model"] and beyond["head_m"] is None and beyond["blocked_discharge"] is not None
    assert 21.5 < one(spark, hydraulics.echo_cm(F.lit(1294)))[0] < 22.5


def test_geometry(spark):
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])
    got = one(spark, geometry.denormalised(corners, F.lit(11), F.lit(5)), geometry.resized(F.lit(1000), F.lit(3), 100), geometry.box_area(F.lit(1), F.lit(1), F.lit(3), F.lit(4)), geometry.colour(F.lit("1, 2,3")), geometry.colour(F.lit("1,2")), geometry.colour(F.lit("1,2,300")), geometry.head_and_tail(F.lit("a/b/c")), geometry.head_and_tail(F.lit("abc")), geometry.kept_box(F.lit(1), F.lit(1), F.lit(1), F.lit(2)), geometry.area_in(F.lit(7)), frames.polygon_mask(corners, 4, 3))
    assert (got[0][2]["x"], got[0][2]["y"]) == (10.0, 4.0) and tuple(got[1]) == (100, 1)
    assert got[2:6] == (6, 66051, None, None) and tuple(got[6]) == ("a", "b/c") and tuple(got[7]) == ("abc", "")
    assert got[8] is False and got[9] == 7.0 and got[10] == [True] * 12
    with pytest.raises(Exception, match="no conversion"):
        one(spark, geometry.area_in(F.lit(7), "m2"))


def test_frame_metrics(spark):
    px = [0, 1, 2, 3, 1, 2]
    rows = [(1, px, None, None), (2, px, [True] * 4 + [False] * 2, [False, False, True, True, True, True]), (3, None, None, None), (4, [0, 0], None, [True, True]), (5, [], None, None)]
    df = spark.createDataFrame(rows, "id int, px array<int>, roi array<boolean>, st array<boolean>")
    got = {r["id"]: r for r in frames.frame_metrics(df, "px", "roi", "st").collect()}
    assert (got[1]["debris_px"], got[1]["water_px"], got[1]["coverage"], got[1]["accumulation_px"], got[1]["accumulation_frac"]) == (3, 2, 0.6, 0, 0.0)
    assert (got[2]["debris_px"], got[2]["water_px"], got[2]["roi_px"], got[2]["accumulation_px"], got[2]["structure_px"], got[2]["accumulation_frac"]) == (2, 1, 4, 2, 2, 1.0)
    assert got[3]["coverage"] is None and got[3]["debris_px"] is None and got[4]["coverage"] is None and got[5]["roi_px"] == 0
    counts = one(spark, frames.class_counts(F.array(*map(F.lit, px))), frames.mapped(F.array(*map(F.lit, px)), [9, 8, 7]), frames.overlaid(F.array(F.lit(1), F.lit(1), F.lit(0)), F.array(F.lit(1), F.lit(0), F.lit(0))))
    assert (counts[0]["background"], counts[0]["water_share"]) == (1, 2 / 6) and counts[1] == [9, 8, 7, None, 8, 7] and counts[2] == [2, 1, 0]


def test_velocities_push_only_what_counts(spark):
    r = random.Random(3)
    rows = [(k, t, r.choice([None, round(r.random() * 9, 4)]), r.choice([0, 3]), r.choice([0.0, 0.1])) for k in "ab" for t in range(60)]
    df = spark.createDataFrame(rows, "k string, t int, raw double, n int, dt double")
    got = {(x["k"], x["t"]): x["velocity_px_s"] for x in frames.velocities(df, "k", ["t"], "raw", "n", "dt", 5).collect()}
    for k in "ab":
        held = []
        for key, t, raw, n, dt in rows:
            if key == k:
                held = [*held, raw][-5:] if raw is not None and n > 0 and dt > 0 else held
                assert got[k, t] == (round(statistics.median(held), 3) if held else None) or abs(got[k, t] - statistics.median(held)) <= 0.0005 + 1e-9


def test_ranks_equal_sorted_lists(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([None, r.randint(0, 20), r.random() * 1000])) for _ in range(800)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")
    got = {x["g"]: x for x in ranks.nearest_ranks(df, ["g"], "v", {"mid": ranks.upper_middle, "p90": ranks.at_share(0.9), "low": ranks.first, "top": ranks.last}).collect()}
    for g in ("a", "b", None):
        s = sorted(float(v) for k, v in rows if k == g and v is not None)
        assert (got[g]["n"], got[g]["mid"], got[g]["p90"], got[g]["low"], got[g]["top"]) == (len(s), s[len(s) // 2], s[min(len(s) - 1, int(0.9 * len(s)))], s[0], s[-1])
    placed = ranks.positions(df, ["g"], "v").collect()
    assert sorted(x["pos"] for x in placed) == list(range(1, len(rows) + 1))
    order = sorted(placed, key=lambda x: x["pos"])
    keys = [((x["g"] is not None, x["g"] or ""), (x["v"] is not None, x["v"] or 0)) for x in order]
    assert keys == sorted(keys)
    assert ranks.nearest_ranks(df.where("false"), ["g"], "v", {"mid": ranks.upper_middle}).count() == 0
    assert ranks.heads(df, ["g"], ["v"], 2).count() == 6


def test_nearest_equals_brute_force(spark):
    r = random.Random(5)
    left = [(i, r.choice("ab"), r.choice([None, r.randint(0, 900)])) for i in range(150)] + [(0, "a", 450)] * 2
    right = [(i, r.choice("ab"), r.randint(0, 900)) for i in range(120)]
    ours = ts.nearest(spark.createDataFrame(left, "l int, d string, lt int"), spark.createDataFrame(right, "r int, d string, rt int"), "lt", "rt", "r", 20, "d")
    got = sorted((x["l"], x["d"], x["lt"] or -1, x["r"] if x["r"] is not None else -1) for x in ours.collect())
    want = []
    for i, d, t in left:
        near = [(abs(t - rt), rt, j) for j, e, rt in right if e == d and abs(t - rt) <= 20] if t is not None else []
        want.append((i, d, t or -1, min(near)[2] if near else -1))
    assert got == sorted(want)


def test_sliding_sum_crosses_buckets(spark):
    minutes = [1435, 1436, 1439, 1440, 1444, 1449, 1450, 2880]
    got = {x["m"]: x["s"] for x in ts.sliding_sum(spark.createDataFrame([(m, 1) for m in minutes], "m int, n int"), "m", "n", 10, 1440, "s").collect()}
    assert got == {m: sum(m - 9 <= x <= m for x in minutes) for m in minutes}


def test_alerts_fire_on_growth_and_latch(spark):
    df = spark.createDataFrame([("a", float(60 * i), v) for i, v in enumerate([0.0, 0.2, 0.4, 0.1, 0.1, None])], "k string, t double, v double")
    rows = ts.alerts(ts.growth(df, "k", "t", "v", 120), "k", ["t"], "v", "growth_per_min", 0.35, 0.15, 2).orderBy("t").collect()
    assert [(r["streak"], r["alert"], r["latched"], r["onset"]) for r in rows] == [(0, False, False, False), (1, False, False, False), (2, True, True, True), (0, False, True, False), (0, False, True, False), (0, False, True, False)]
    assert rows[2]["reason"] == "area 0.40 >= 0.35; growth 0.200/min >= 0.15" and rows[0]["reason"] == ""


def plain_levels(rows, enter, leave, rains, dwell):
    level, low, out = 0, None, []
    for t, h, r in rows:
        if h is not None:
            want = 2 if h > enter[1] or (r or 0) > rains[1] else 1 if h > enter[0] or (r or 0) > rains[0] else 0
            if want > level:
                level, low = want, None
            elif level and h < leave[level - 1] and (r or 0) <= rains[level - 1]:
                low = t if low is None else low
                if t - low >= dwell:
                    level, low = level - 1, None
            else:
                low = None
        out.append(states.LEVELS[level])
    return out


def test_levels_and_throttle_equal_plain_loops(spark):
    r = random.Random(6)
    rows = [(k, float(t), i, r.choice([None, r.random() * 80]), r.choice([0.0, 20.0, 40.0, None])) for k in ("a", "b", None) for i, t in enumerate(sorted(r.choices(range(400), k=150)))]
    df = spark.createDataFrame(rows, "k string, t double, i int, h double, r double")
    got = {(x["k"], x["i"]): x["level"] for x in states.levels(df, "k", "t", "h", "r", dwell=15.0, seq="i").collect()}
    kept = {(x["k"], x["i"]) for x in states.throttled(df, "k", "t", 12.0, seq="i").collect()}
    for k in ("a", "b", None):
        mine = [x for x in rows if x[0] == k]
        assert [got[k, x[2]] for x in mine] == plain_levels([(x[1], x[3], x[4]) for x in mine], (30, 60), (25, 55), (10, 30), 15)
        last = None
        for x in mine:
            go = last is None or x[1] - last >= 12
            last = x[1] if go else last
            assert ((k, x[2]) in kept) == go
    assert plain_levels([(0, 1.0, 20.0), (1, 1.0, 40.0)], (30, 60), (25, 55), (10, 30), 60) == ["WASPADA", "BAHAYA"]


def test_level_clock_wraps(spark):
    rows = [("a", 4294947296.0, 0, 31.0), ("a", 4294947296.0, 1, 20.0), ("a", 10000.0, 2, 20.0), ("a", 50000.0, 3, 20.0)]
    df = spark.createDataFrame(rows, "k string, t double, i int, h double").withColumn("r", F.lit(0.0))
    got = {x["i"]: x["level"] for x in states.levels(df, "k", "t", "h", "r", dwell=60000.0, seq="i", wrap=2.0**32).collect()}
    assert got == {0: "WASPADA", 1: "WASPADA", 2: "WASPADA", 3: "AMAN"}


def test_greedy_split_equals_the_rule(spark):
    import hashlib

    names, shares, r = ("train", "val", "test"), (0.7, 0.15, 0.15), random.Random(7)
    for n in (1, 2, 3, 5, 12):
        sizes = {f"g{i}": r.randint(1, 50) for i in range(n)} if n != 2 else {"g0": 10, "g1": 10}
        df = spark.createDataFrame([("d", g, s) for g, s in sizes.items()], "d string, g string, n int")
        order = sorted(sizes, key=lambda g: hashlib.md5(f"42:d:{g}".encode()).hexdigest())
        filled, want, total = [0, 0, 0], {}, sum(sizes.values())
        for i, g in enumerate(order):
            k = i if n >= 3 and i < 3 else max(range(3), key=lambda j: (shares[j] * total - filled[j], -j))
            filled[k] += sizes[g]
            want[g] = names[k]
        assert {x["g"]: x["split"] for x in states.greedy_split(df, "d", "g", "n").collect()} == want
        if n == 2:
            assert set(want.values()) == {"train"}


def test_scores_and_drops(spark):
    cm = spark.createDataFrame([(0, 0, 5), (0, 1, 2), (1, 1, 3), (1, 0, 1)], "t int, p int, n long")
    got = {r["cls"]: r for r in evaluation.class_scores(cm, "t", "p", (0, 1, 2)).collect()}
    assert math.isclose(got[0]["iou"], 5 / 8, rel_tol=1e-6) and math.isclose(got[1]["prec"], 3 / 5, rel_tol=1e-6) and got[2]["iou"] is None
    assert math.isclose(evaluation.mean_iou(evaluation.class_scores(cm, "t", "p", (0, 1, 2))).first()[0], (5 / 8 + 3 / 6) / 2, rel_tol=1e-6)
    assert math.isclose(evaluation.pixel_accuracy(cm, "t", "p").first()[0], 8 / 11)
    df = spark.createDataFrame([(1024, 80.0), (512, 60.0), (256, float("nan")), (128, None)], "size int, s double")
    assert {r["size"]: r["drop_pct"] for r in evaluation.drop_from_largest(df, "size", "s").collect()} == {1024: 0.0, 512: 25.0, 256: None, 128: None}
    pairs = spark.createDataFrame([(255, 1), (0, 1), (None, 1), (7, 0)], "t int, p int")
    assert [r[0] for r in pairs.where(evaluation.valid(F.col("t"), 2)).collect()] == [0]
    assert [r[0] for r in pairs.select(evaluation.unlabelled(F.col("t"), F.col("p"))).collect()] == [255, 1, 1, 0]
    lat = evaluation.latency(spark.createDataFrame([("m", float(x)) for x in (4, 1, 3, 2)], "m string, ms double"), ["m"], "ms").first()
    assert (lat["n"], lat["p50"], lat["p90"], lat["mean"], lat["fps"]) == (4, 3.0, 4.0, 2.5, 400.0) and math.isclose(lat["std"], statistics.pstdev([1, 2, 3, 4]))
    err = evaluation.coverage_error(spark.createDataFrame([(0.5, 0.4), (0.1, None), (0.2, 0.5)], "a double, b double"), "a", "b").first()
    assert math.isclose(err["mae"], 0.2) and math.isclose(err["max_error"], 0.3) and err["n"] == 2


def test_early_stop_ignores_nan(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([float("nan"), 1.0, 0.5, float("nan"), 0.9, 2.0])] + [("b", 0, float("nan")), ("b", 1, float("nan"))], "k string, e int, s double")
    got = {r["k"]: (r["best"], r["stop_epoch"], r["epochs"]) for r in evaluation.early_stop(df, ["k"], "e", "s", 2).collect()}
    assert got == {"a": (2.0, 4, 6), "b": (None, 2, 2)}


def test_split_checks(spark):
    df = spark.createDataFrame([("d", "g1", "train"), ("d", "g1", "val"), ("d", "g2", "train"), ("d", None, "test")], "d string, g string, split string")
    assert [tuple(r) for r in splits.straddling(df, ["g"]).collect()] == [("g1", 2)]
    dev = {r["split"]: (r["n"], r["dev"], r["empty"]) for r in splits.split_deviation(df.where("split <> 'test'"), "d", {"train": 0.7, "val": 0.15, "test": 0.15}).collect()}
    assert dev["test"] == (0, 0.15, True) and dev["train"][0] == 2
    with pytest.raises(Exception, match="repeated key: g1"):
        splits.unique_or_fail(df, ["g"]).collect()
    assert splits.unique_or_fail(df, ["g", "split"]).count() == 4
    assert splits.dangling(df.select("g"), df.select("g").distinct(), ["g"]).where("dangling").count() == 0
    folds = splits.location_folds(spark.createDataFrame([(x,) for x in "abcd"], "l string"), "l").collect()
    assert {(r["test_loc"], r["val_loc"]) for r in folds} == {("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")} and len(folds) == 8


def test_paths_resolve_or_fail(spark):
    wanted = spark.createDataFrame([("a/x.jpg", "x.jpg"), ("q/y.jpg", "y.jpg"), ("q/z.jpg", "z.jpg"), ("q/w.jpg", "w.jpg")], "p string, n string")
    files = spark.createDataFrame([("a/x.jpg", "x.jpg"), ("b/x.jpg", "x.jpg"), ("b/y.jpg", "y.jpg"), ("b/z.jpg", "z.jpg"), ("c/z.jpg", "z.jpg")], "p string, n string")
    got = {r["p"]: r["resolved"] for r in splits.resolved(wanted, files, "p", "n", strict=False).collect()}
    assert got == {"a/x.jpg": "a/x.jpg", "q/y.jpg": "b/y.jpg", "q/z.jpg": None, "q/w.jpg": None}
    with pytest.raises(Exception, match="ambiguous file name: z.jpg"):
        splits.resolved(wanted, files, "p", "n").collect()


def test_findings(spark):
    shares = spark.createDataFrame([("a", 0.0, 0.5, "labels"), ("b", 0.2, 0.0, "none"), ("c", 0.2, 0.0, "labels"), ("d", None, None, None)], "ds string, debris double, water double, water_source string")
    found = {(r["scope"], r["level"]) for r in validation.share_findings(shares, "ds").collect()}
    assert found == {("a", "error"), ("c", "warning"), ("d", "error"), ("d", "warning")}
    meta = spark.createDataFrame([("s1", "i1", "m1"), ("s2", "i2", None)], "id string, image string, mask string")
    there = spark.createDataFrame([("i1",), ("i2",), ("m9",)], "path string")
    gone = validation.missing_files(meta, there, "id", ["image", "mask"])
    assert sorted(tuple(r) for r in gone.collect()) == [("s1", "error", "mask missing (m1)"), ("s2", "error", "mask missing")]
    assert tuple(validation.totals(gone).first()) == (2, 0)
    errors = spark.createDataFrame([("ValueError: x",), ("ValueError",), ("OSError: a: b",), (None,)], "e string")
    assert {tuple(r) for r in validation.failures(errors, "e").collect()} == {("ValueError", 2), ("OSError", 1)}
    labelled = spark.createDataFrame([("a",), ("b",), (None,)], "l string")
    table = spark.createDataFrame([("a", 1)], "l string, slot int")
    assert sorted(r["mapped"] for r in validation.mapped_labels(labelled, table, "l", "slot", "ignore").collect()) == [1, 255, 255]
    with pytest.raises(Exception, match="unmapped label"):
        validation.mapped_labels(labelled, table, "l", "slot").collect()
    with pytest.raises(Exception, match="no verdict: maybe"):
        one(spark, validation.verdict(F.lit("maybe")))
    assert [one(spark, validation.verdict(F.lit(x).cast("string")))[0] for x in (" OK", None)] == ["ok", ""]
    got = one(spark, *[validation.flag(F.lit(a), F.lit(s), F.lit(d), 10, 100, 0.5) for a, s, d in ((5, 0.1, False), (500, 0.1, False), (50, 0.1, False), (50, 0.9, False), (50, 0.9, True))])
    assert list(got) == ["too_small", "too_large", "low_score", "no_debris_seed", ""]
    echo = spark.createDataFrame([("a", None), ("b", 10.0), ("c", 500.0), ("d", 40.0), ("d", 60.0), ("e", 110.0)], "k string, v double")
    assert {r["k"]: (r["state"], r["height"]) for r in validation.echo_state(echo, "k", "v", 20, 100, 20).collect()} == {"a": ("timeout", None), "b": ("too_close", None), "c": ("out_of_range", None), "d": ("ok", 40.0), "e": ("ok", 0.0)}
    shares = validation.class_shares(labelled.where("false"), ["l"])
    assert shares.count() == 0


def test_latest_pair_of_empty_tables(spark):
    df = spark.createDataFrame([(1, "x"), (3, "y"), (2, "z")], "t int, v string")
    row = ts.latest_pair(df, df.where("false"), ["t"], ["t"]).first()
    assert row["left"]["v"] == "y" and row["right"] is None


def test_outlook_payload_and_prefixes(spark):
    rows = [("a", 0, 30.0, 9.0), ("a", 1, 5.0, 0.2), ("a", 2, 4.0, 0.7), ("a", 3, 1.0, 2.0), ("b", 0, 1.0, None), ("c", 0, -3.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, pos int, h double, mm double")
    got = {r["k"]: (r["total"], r["rain"] and r["rain"]["at"]) for r in ts.rain_outlook(df, "k", "pos", F.col("h"), F.col("mm")).collect()}
    assert got == {"a": (2.9, 2), "b": (None, None), "c": (0.0, None)}
    pair = ts.latest_pair(df.select("pos", "mm"), df.where("false").select("pos"), ["pos"], ["pos"])
    row = ts.payload(pair, F.lit(5), {"mm": "rain"}, {"pos": "at"}, F.lit("clear"), F.array(F.lit("x"))).first()
    assert row["sensor"]["rain"] == 2.0 and row["camera"] is None and row["state"] == "clear"
    assert ts.prefixed(df, "src_", ("k",)).columns == ["k", "src_pos", "src_h", "src_mm"]
    assert one(spark, ts.prefixed_map("val", F.lit("d"), F.array(F.lit("iou")), F.array(F.lit(0.5))))[0] == {"val_d_iou": 0.5}
