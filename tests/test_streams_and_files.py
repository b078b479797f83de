"""Streams give what their batch twins give; files come back as written."""

import json

from pyspark.sql import functions as F

from tidemark.operators import masks, states
from tidemark.sources import annotations, sinks
from tidemark.streaming import windows

DATA = "/root/testdata/sf0.001"


def late_free(spark):
    return spark.read.parquet(f"{DATA}/events.parquet")


def test_level_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("ab"[i % 2], float(i), float(i * 37 % 80), 0.0) for i in range(200)], "k string, t double, h double, r double")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = windows.drain(windows.level_stream(stream, "k", "t", "h", "r", dwell=5.0), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = states.levels(rows, "k", "t", "h", "r", dwell=5.0).select("k", "t", "level")
    assert sorted(got.collect()) == sorted(want.collect())


def test_window_stream_counts_every_tip_it_closed(spark, tmp_path):
    folder = str(tmp_path / "in")
    late_free(spark).coalesce(1).write.parquet(folder)
    got = windows.drain(windows.rain_windows(windows.event_stream(spark, folder)), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = {r["w"]: r["n"] for r in late_free(spark).where("event_type = 'click'").groupBy(F.window(F.col("ts").cast("timestamp"), "10 minutes", "1 minute")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("w"), "n").collect()}
    closed = {r["w"]: r["tips"] for r in got.select(F.col("window.start").alias("w"), "tips").collect()}
    assert closed and all(want[w] == n for w, n in closed.items())


def test_insert_is_idempotent_and_upsert_keeps_the_last(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("b", 1, None)], "device string, ts int, v double")
    path = str(tmp_path / "t")
    assert [sinks.insert_new(spark, rows, path, ["device", "ts"], ["v"]) for _ in range(2)] == [2, 0]
    assert {(r["device"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 1.0), ("b", None)}
    new = spark.createDataFrame([("a", 1, 4.2)], rows.schema)
    assert {r["v"] for r in sinks.upserted(rows.limit(1), new, ["device", "ts"], "v").collect()} == {4.2}


def test_splits_are_written_as_lists(spark, tmp_path):
    rows = spark.createDataFrame([("train", "b"), ("train", "a"), ("val", "c")], "split string, id string")
    sinks.write_splits(rows, str(tmp_path / "s"))
    assert sorted(r["id"] for r in annotations.trimmed_lines(spark, str(tmp_path / "s" / "split=train")).collect()) == ["a", "b"]


def test_coco_images_keep_without_polygons(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 4, "height": 4}, {"id": 2, "file_name": "b.jpg", "width": 4, "height": 4}],
        "categories": [{"id": 7, "name": "water"}, {"id": 8, "name": "debris"}, {"id": 9, "name": "water"}],
        "annotations": [{"id": 1, "image_id": 1, "category_id": 9, "segmentation": [[0, 0, 1, 0, 1, 1], [0, 0]]}],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc))
    rows = {r["file_name"]: (r["label"], r["slot"]) for r in annotations.coco_instances(spark, str(tmp_path / "c.json")).collect()}
    assert rows == {"a.jpg": ("water", 2), "b.jpg": (None, None)}


def test_voc_boxes(spark, tmp_path):
    box = lambda a, b: f"<object><name>x</name><bndbox><xmin>{a}</xmin><ymin>0</ymin><xmax>{b}</xmax><ymax>2</ymax></bndbox></object>"
    (tmp_path / "a.xml").write_text(f"<annotation><filename>a.jpg</filename>{box(0, 2)}{box(3, 3)}</annotation>")
    assert annotations.voc_boxes(spark, str(tmp_path)).count() == 1


def test_polygons(spark):
    square = F.array(*(F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y")) for x, y in ((0, 0), (9, 0), (9, 9), (0, 9))))
    grid = spark.range(400).select((F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))
    assert grid.where(masks.inside(square, F.col("x"), F.col("y"))).count() == 100
    unit = F.array(*(F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))))
    row = spark.range(1).select(masks.polygon_area(unit).alias("a"), masks.valid_polygon(unit).alias("ok"), masks.valid_polygon(square).alias("no")).first()
    assert (row["a"], row["ok"], row["no"]) == (1.0, True, False)


def test_clumps(spark):
    px = [2, 2, 0, 0, 2, 2, 0, 0, 0, 0, 0, 2]
    row = masks.promoted(spark.createDataFrame([(1, px)], "frame_id long, px array<int>"), 4, 4).first()
    assert (row["px"], row["n_clumps"]) == ([3, 3, 0, 0, 3, 3, 0, 0, 0, 0, 0, 2], 1)
