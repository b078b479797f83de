"""Regions after closing, reports and readers by name."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import masks
from tidemark.sources import adapters, reports


def frames(spark, *px):
    return spark.createDataFrame(list(enumerate(px)), "frame_id long, px array<int>")


def test_closing_joins_regions_and_paints_only_debris(spark):
    gap = [2, 2, 1, 2, 2, 1, 1, 1, 1, 1]
    row = masks.promoted(frames(spark, gap), 10, 5, close=3).first()
    assert (row["px"], row["n_clumps"]) == ([3, 3, 1, 3, 3, 1, 1, 1, 1, 1], 1)
    assert masks.promoted(frames(spark, gap), 10, 5).first()["px"] == gap
    assert masks.promoted(frames(spark, gap), 10, share=0.2).first()["n_clumps"] == 2
    corner = [2, 0, 0, 2]
    assert [masks.promoted(frames(spark, corner), 2, 2, corners=c).first()["n_clumps"] for c in (True, False)] == [1, 0]
    assert [(r["px"], r["n_clumps"]) for r in masks.promoted(frames(spark, None, []), 4, 1).orderBy("frame_id").collect()] == [(None, 0), ([], 0)]
    with pytest.raises(ValueError):
        masks.promoted(frames(spark, gap), 10, 5, close=4)


def test_regions_equal_a_flood_fill(spark):
    r, w = random.Random(3), 12
    grids = [[r.choice((1, 2)) for _ in range(w * 9)] for _ in range(20)]
    for corners in (True, False):
        got = masks.promoted(frames(spark, *grids), w, 6, corners=corners).orderBy("frame_id").collect()
        for grid, row in zip(grids, got, strict=True):
            want, seen, n = list(grid), set(), 0
            for start in range(len(grid)):
                if grid[start] != 2 or start in seen:
                    continue
                region, todo = {start}, [start]
                while todo:
                    y, x = divmod(todo.pop(), w)
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            at = (y + dy) * w + x + dx
                            if (corners or not (dy and dx)) and 0 <= x + dx < w and 0 <= y + dy < 9 and grid[at] == 2 and at not in region:
                                region.add(at)
                                todo.append(at)
                seen |= region
                if len(region) >= 6:
                    n += 1
                    for at in region:
                        want[at] = 3
            assert (row["px"], row["n_clumps"]) == (want, n)


def test_reports(spark, tmp_path):
    data = spark.createDataFrame([("b|c", None, 2), ("a", 0.5, 3), ("n", float("nan"), None)], "dataset string, share double, n int")
    assert reports.table_lines(data, ["dataset"], {"share": 2}) == ["| dataset | share | n |", "|---|---|---|", "| a | 0.50 | 3 |", "| b\\|c | - | 2 |", "| n | n/a | - |"]
    found = spark.createDataFrame([("a", "error", "gone"), ("splits", "warning", "few")], "scope string, level string, message string")
    lines = reports.validation_report(data, data.select("dataset", "n"), found)
    assert "errors: 1, warnings: 1" in lines and lines.index("| error | a | gone |") + 1 == lines.index("| warning | splits | few |")
    assert "not measured yet" in reports.comparison_report(data) and reports.comparison_report(data, data, ["end"])[-1] == "end"
    path = str(tmp_path / "r")
    reports.write_report(spark, lines, path)
    assert [r["value"] for r in spark.read.text(path).collect()] == lines


def test_readers_by_name(spark, tmp_path):
    assert adapters.registered() == ["coco_polygon", "semantic_png", "voc_bbox"]
    with pytest.raises(KeyError):
        adapters.samples(spark, "none", {})
    with pytest.raises(ValueError):
        adapters.reader("voc_bbox")(None)
    doc = {"images": [{"id": 1, "file_name": "v1/a_01.jpg"}, {"id": 2, "file_name": "b.jpg"}], "categories": [{"id": 7, "name": "water"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 7, "segmentation": [[0, 0, 1, 0, 1, 1]]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    config = {"dataset": "d", "annotations": str(tmp_path / "c.json")}
    rows = {r["sample_id"]: (r["group"], r["label"], r["polygon"]) for r in adapters.samples(spark, "coco_polygon", config).collect()}
    assert rows == {"v1__a_01": ("v1", "water", [0, 0, 1, 0, 1, 1]), "b": ("d", None, None)}
    groups = {how: sorted(r["group"] for r in adapters.samples(spark, "coco_polygon", config | {"group": how}).collect()) for how in ("stem", "constant", r"^(.)_")}
    assert groups == {"stem": ["a", "b"], "constant": ["d", "d"], r"^(.)_": ["a", "b"]}
    for kind in ("images", "masks"):
        (tmp_path / kind / "s").mkdir(parents=True)
        (tmp_path / kind / "s" / "x.png").write_bytes(b"x")
    pair = adapters.samples(spark, "semantic_png", {"dataset": "d", "images": str(tmp_path / "images"), "masks": str(tmp_path / "masks")}).first()
    assert pair["group"] == "s" and pair["mask"].endswith("masks/s/x.png")


def as_text(counts):
    """The compressed form, number by number."""
    out = ""
    for i, n in enumerate(counts):
        x, more = n - (counts[i - 2] if i > 2 else 0), True
        while more:
            low = x & 31
            x >>= 5
            more = x != (-1 if low & 16 else 0)
            out += chr(48 + (low | (32 if more else 0)))
    return out


def test_run_lengths(spark):
    r, made = random.Random(8), []
    for i in range(60):
        h, w = r.randint(1, 30), r.randint(1, 30)
        mask = [[int(r.random() < 0.5) for _ in range(w)] for _ in range(h)] if i % 2 else [[i // 2 % 2] * w for _ in range(h)]
        counts, on = [0], 0
        for x in range(w):
            for y in range(h):
                if mask[y][x] != on:
                    counts.append(0)
                    on = mask[y][x]
                counts[-1] += 1
        made.append((i, as_text(counts), h, w, counts, [v for row in mask for v in row]))
    rows = spark.createDataFrame([m[:4] for m in made] + [(98, "", 2, 2), (99, None, 2, 2), (100, "4", 3, 3)], "id int, t string, h int, w int")
    rows = rows.withColumn("c", masks.run_lengths(F.col("t"))).withColumn("m", masks.run_mask(F.col("c"), F.col("h"), F.col("w")))
    got = {row["id"]: (row["c"], row["m"]) for row in rows.collect()}
    assert all(got[i] == (counts, mask) for i, _, _, _, counts, mask in made)
    assert got[98] == ([], None) and got[99] == (None, None) and got[100] == ([4], None)


def test_polygons_and_run_lengths_in_one_file(spark, tmp_path):
    mask, counts = [0, 1, 1, 0, 1, 0], [2, 3, 1]  # 2 high, 3 wide; down the columns 0 0 1 1 1 0
    doc = {
        "images": [{"id": i, "file_name": f"{i}.jpg"} for i in range(1, 7)],
        "categories": [{"id": 7, "name": "water"}],
        "annotations": [{"id": i, "image_id": i, "category_id": 7, "segmentation": x} for i, x in enumerate(([[0, 0, 1, 0, 1, 1]], {"counts": counts, "size": [2, 3]}, {"counts": as_text(counts), "size": [2, 3]}, [], {"counts": as_text([43, 7]), "size": [50, 1]}, {"counts": [4], "size": [2, 2]}), 1)],
    }
    assert as_text([43, 7])[0] == "["
    (tmp_path / "c.json").write_text(json.dumps(doc))
    rows = adapters.samples(spark, "coco_polygon", {"dataset": "d", "annotations": str(tmp_path / "c.json")}).collect()
    got = {r["sample_id"]: (r["label"], r["polygon"], r["pixels"], r["mask_height"], r["mask_width"]) for r in rows}
    assert len(rows) == 6 and got.pop("5")[2:] == ([0] * 43 + [1] * 7, 50, 1) and got.pop("6")[2:] == ([0] * 4, 2, 2)
    assert got == {"1": ("water", [0, 0, 1, 0, 1, 1], None, None, None), "2": ("water", None, mask, 2, 3), "3": ("water", None, mask, 2, 3), "4": (None, None, None, None, None)}
