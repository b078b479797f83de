"""Delivered batches, listings, sinks, and monitors in a stream against their batch twins."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import timeseries as ts
from tidemark.sources import records, sinks
from tidemark.streaming import monitors, windows

GOOD = "t,5,1.5,nan,1,5,,0,,AMAN,0,ntp,-60,"


def test_envelopes_are_taken_whole(spark):
    body = lambda *lines, device="d": json.dumps({"device": device, "rows": [{"csv": x} for x in lines]})
    made = [(1, body(GOOD, GOOD)), (2, body(GOOD, "a,b")), (3, "no json"), (4, body(device=" ")), (5, body()), (6, None), (7, body("ts_utc,x", GOOD)), (8, body(GOOD, GOOD.replace("1.5", "inf")))]
    out = records.envelopes(spark.createDataFrame(made, "batch_id int, value string"))
    good, bad = records.quarantined(out)
    assert sorted((r["batch_id"], r["pos"], r["jarak_cm"], r["tinggi_cm"]) for r in good.collect()) == [(1, 0, 1.5, None), (1, 1, 1.5, None), (7, 1, 1.5, None)]
    assert {r["batch_id"] for r in bad.collect()} == {2, 3, 4, 6, 8}


def test_line_readers(spark, tmp_path):
    (tmp_path / "v.csv").write_text("sample_id,verdict\na,OK\nb,\nc,reject\n")
    assert sorted(tuple(r) for r in records.verdicts(spark, str(tmp_path / "v.csv")).collect()) == [("a", "ok"), ("b", ""), ("c", "reject")]
    (tmp_path / "w.csv").write_text("sample_id,verdict\na,ok\nb,maybe\n")
    with pytest.raises(Exception, match="line 3: no verdict: maybe"):
        records.verdicts(spark, str(tmp_path / "w.csv")).collect()
    (tmp_path / "m.jsonl").write_text('{"sample_id": "a", "width": 3}\n')
    assert records.json_lines(spark, str(tmp_path / "m.jsonl")).first()["width"] == 3
    (tmp_path / "cpu").write_text("vendor: x\nmodel name\t: Some CPU\nmodel name\t: Other\n")
    assert [r["value"] for r in records.first_value(spark, str(tmp_path / "cpu")).collect()] == ["Some CPU"]
    assert records.first_value(spark, str(tmp_path / "cpu"), ("nothing",)).count() == 0


def test_settings_controls_and_runs(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"site": "x",\n "gate": {"cd": 0.6}}')
    assert records.settings(spark, str(tmp_path / "s.json"), ("site",))["gate"]["cd"] == 0.6
    with pytest.raises(ValueError, match="lacks area"):
        records.settings(spark, str(tmp_path / "s.json"), ("area",))
    read = lambda name, valid=None: [r["source"] for r in records.control(spark, str(tmp_path / name), "source string", valid).collect()]
    (tmp_path / "broken.json").write_text('{"source": ')
    (tmp_path / "c.json").write_text('{"source": "7"}')
    assert read("none.json") == read("broken.json") == [] and read("c.json") == ["7"] and read("c.json", F.col("source") == "8") == []
    for run in ("r1", "r2"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "best.pt").write_bytes(b"x")
        (tmp_path / "runs" / run / "log.txt").write_bytes(b"x")
    assert sorted(r["run"] for r in records.runs(spark, str(tmp_path / "runs")).collect()) == ["r1", "r2"]
    assert records.table_or_empty(spark, str(tmp_path / "t"), "a int").count() == 0


def test_series_sink_commits_both_at_once(spark, tmp_path, monkeypatch):
    columns = ("ts_utc", "ts_epoch", "site", "coverage", "alert", "head_m")
    schema = "ts_epoch double, coverage double, alert boolean, extra int"
    rows = spark.createDataFrame([(0.5, 0.25, True, 9), (60.9, None, None, 9)], schema)
    folder = str(tmp_path / "s")
    write = sinks.series_sink(folder, columns, {"head_m": "double"}, "s", ["ts_epoch"])
    both = lambda: (sinks.committed(spark, folder).count(), sinks.committed(spark, folder, "timeseries").count())
    write(rows, 0)
    write(rows, 0)  # the same batch again
    assert both() == (2, 2)
    from pyspark.sql import DataFrameWriter

    plain = DataFrameWriter.csv

    def broken(self, *a, **k):
        raise OSError("disk full")

    monkeypatch.setattr(DataFrameWriter, "csv", broken)
    more = spark.createDataFrame([(0.5, 0.25, True, 9), (99.0, 0.5, False, 9), (99.0, 0.5, False, 9)], schema)
    with pytest.raises(OSError, match="disk full"):
        write(more, 1)
    assert both() == (2, 2)  # the table's half is not seen
    monkeypatch.setattr(DataFrameWriter, "csv", plain)
    write(more, 1)
    write(more.limit(1), 2)  # delivered before
    assert both() == (3, 3)
    got = sinks.committed(spark, folder)
    assert got.columns == list(columns) and sorted((r["ts_utc"], r["site"], r["alert"]) for r in got.collect()) == [("1970-01-01T00:00:00Z", "s", 1), ("1970-01-01T00:01:00Z", "s", None), ("1970-01-01T00:01:39Z", "s", 0)]
    sinks.series_sink(folder, columns, {"head_m": "double"}, "s", run="1")(rows, 0)  # another stream counts anew
    assert both() == (5, 5)


def test_review_list_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "", 0.9), (2, "low_score", 0.3), (3, "too_small", 0.2), (4, "", 0.5)], "id int, flag string, score double")
    path = str(tmp_path / "review")
    sinks.write_review(rows, path, "flag", "score", "id")
    made = spark.read.option("header", True).csv(path)
    assert [r["file"] for r in made.collect()] == ["3", "2", "4", "1"]
    with pytest.raises(Exception, match="exists"):
        sinks.write_review(rows, path, "flag", "score", "id")
    sinks.write_table(rows, str(tmp_path / "epochs"), ["id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "epochs")).count() == 4
    sinks.append_records(rows.limit(2), str(tmp_path / "j"), ["id"])
    sinks.append_records(rows, str(tmp_path / "j"), ["id"])
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    n = {r["split"]: r["n"] for r in sinks.write_splits(rows.select(F.lit("a").alias("split"), "id"), str(tmp_path / "s"), rows_a_file=2).collect()}
    assert n == {"a": 4} and spark.read.text(str(tmp_path / "s")).count() == 4


def test_monitor_stream_equals_batch_twins(spark, tmp_path):
    r = random.Random(9)
    rows, t = [], {"a": 0.0, "b": 0.0}
    for i in range(240):
        k = r.choice("ab")
        t[k] += r.choice([0.5, 20.0, 90.0, 700.0])
        rows.append((k, t[k], r.choice([None, round(r.random(), 3)]), r.choice([None, None, float(i)]), "s1" if t[k] < 9000 else "s2"))
    schema = "k string, t double, f double, slow double, seg string"
    for i in range(3):
        spark.createDataFrame(rows[80 * i : 80 * i + 80], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = monitors.monitored(stream, "k", "t", "f", "slow", "seg", 5, 300.0, 0.6, 0.2, 2)
    got = windows.drain(made, str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = spark.createDataFrame(rows, schema).withColumn("ks", F.concat("k", "seg"))
    # growth of the batch twin asks for rows whose value is there
    want = ts.alerts(ts.growth(ts.carried(ts.rolling_nonnull(batch, "ks", ["t"], "f", 5, "smoothed"), "ks", ["t"], F.col("slow"), "t", "carried", "age_s"), "ks", "t", "f", 300), "ks", ["t"], "f", "growth_per_min", 0.6, 0.2, 2)
    columns = ["k", "t", "smoothed", "growth_per_min", "streak", "alert", "latched", "carried", "age_s"]
    plain = lambda df: sorted(tuple("null" if v is None or v != v else round(v, 9) if isinstance(v, float) else v for v in x) for x in df.select(*columns).collect())
    assert plain(got) == plain(want)


def test_silence_and_side_input(spark, tmp_path):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    for i, (k, s) in enumerate([("a", 10000), ("b", 10060), ("b", 13000), ("b", 19000)]):
        spark.range(1).select(F.lit(k).alias("k"), at(s).alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("at", "1 second")
    got = windows.drain(monitors.silent(stream, "k"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r["k"], int(r["quiet_since"].timestamp())) for r in got.collect()) == [("a", 10000), ("b", 10060), ("b", 13000)]
    (tmp_path / "c.json").write_text('{"k": "b"}')
    seen = []
    read = lambda s: records.control(s, str(tmp_path / "c.json"), "k string")
    write = monitors.with_side_input(read, lambda rows, side: rows.join(F.broadcast(side), "k"), lambda df, n: seen.append(df.count()))
    monitors.drained(spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "in")), str(tmp_path / "cp2"), write)
    assert sum(seen) == 3


def test_stream_twins_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.event_stream(spark, str(tmp_path / "in"))
    once = windows.drain(windows.first_per_key(stream, ["event_id"]), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert once.count() == events.select("event_id").distinct().count()
    got = {(r["event_type"], r["w"]): (r["median"], r["n"]) for r in windows.drain(windows.minute_medians(stream), str(tmp_path / "o2"), str(tmp_path / "c2")).select("event_type", F.col("window.start").alias("w"), "median", "n").collect()}
    cents = F.round(F.col("value") * 100).cast("bigint")
    want = events.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 minute").alias("w")).agg(F.median(cents).alias("m"), F.count(F.lit(1)).alias("n"))
    every = {(r["event_type"], r["w"]["start"]): (r["m"], r["n"]) for r in want.collect()}
    assert got and all(every[k] == v for k, v in got.items())
