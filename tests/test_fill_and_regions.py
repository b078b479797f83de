"""Scanline fill and regions by runs against plain loops."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fill, frames, regions


def inside(p, x, y):
    """Every pixel against every edge."""
    odd = False
    for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
        if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and (x - ax) * abs(by - ay) < (bx - ax) * (y - ay) * (1 if by > ay else -1):
            odd = not odd
    return odd


@pytest.mark.parametrize("seed", range(6))
def test_fill_equals_every_pixel_against_every_edge(seed):
    rng = random.Random(seed)
    for _ in range(60):
        w, h = rng.randrange(1, 14), rng.randrange(1, 11)
        p = [(rng.randrange(-3, w + 3), rng.randrange(-3, h + 3)) for _ in range(rng.randrange(1, 9))]
        want = [[inside(p, x, y) for x in range(w)] for y in range(h)]
        assert fill.filled(p, w, h).tolist() == want, (p, w, h)


def test_a_real_frame_takes_milliseconds(spark):
    turn = np.linspace(0, 2 * np.pi, 64, endpoint=False)
    star = np.stack([320 + 300 * np.cos(turn) * (1 + np.arange(64) % 2) / 2, 180 + 170 * np.sin(turn) * (1 + np.arange(64) % 2) / 2], 1).round()
    fill.filled(star, 640, 360)
    began = time.perf_counter()
    assert 10_000 < fill.filled(star, 640, 360).sum() < 230_400
    assert time.perf_counter() - began < 0.1
    rows = spark.createDataFrame([(i, [(float(x) / 639, float(y) / 359) for x, y in star]) for i in range(4)] + [(4, None)], "i int, p array<struct<x:double,y:double>>").coalesce(1)
    got = rows.select("i", frames.polygon_mask(F.col("p"), 640, 360).alias("m")).select("i", F.size(F.filter("m", lambda v: v)).alias("n"), F.col("m").isNull().alias("none")).orderBy("i").collect()
    assert [r["n"] for r in got[:4]] == [int(fill.filled(star, 640, 360).sum())] * 4 and got[4]["none"]


def test_shapes_to_masks(spark):
    schema = "image string, w int, h int, slot int, polygon array<double>, pixels array<int>"
    square = lambda a, b: [a, a, b, a, b, b, a, b]
    rows = [("a", 5, 4, 1, [float(v) for v in square(0, 3)], None), ("a", 5, 4, 2, [0.4, 0.0, 1.2, 0.0, 1.0, 1.49, 0.0, 1.0], None), ("a", 5, 4, 3, None, [0] * 19 + [1]), ("a", 5, 4, 3, [0.0, 0.0], None), ("b", 2, 1, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r["image"]: np.array(r["px"]).reshape(r["height"], r["width"]).tolist() for r in fill.painted_masks(df, "image", "w", "h", "slot", pixels="pixels", paint_order=[1]).collect()}
    assert got == {"a": [[1, 1, 1, 1, 0]] * 3 + [[1, 1, 1, 1, 3]], "b": [[0, 0]]}
    got = fill.painted_masks(df, "image", "w", "h", "slot", paint_order=[2]).where("image = 'a'").first()["px"]
    assert np.array(got).reshape(4, 5)[:2].tolist() == [[2, 2, 1, 1, 0], [2, 2, 1, 1, 0]]
    for bad in (("c", None, 3, 1, None, None), ("c", 2, 2, 1, None, [1])):
        with pytest.raises(Exception, match="needs a width|do not fill"):
            fill.painted_masks(spark.createDataFrame([bad], schema), "image", "w", "h", "slot", pixels="pixels").collect()
    assert fill.painted_masks(df.where("false"), "image", "w", "h", "slot").count() == 0


def flood(on, corners):
    """A number per pixel of each region, by flood fill."""
    label, n = np.zeros(on.shape, int), 0
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (corners or not (dy and dx))]
    for y, x in zip(*np.nonzero(on), strict=True):
        if not label[y, x]:
            n += 1
            label[y, x], todo = n, [(y, x)]
            while todo:
                cy, cx = todo.pop()
                for dy, dx in steps:
                    a, b = cy + dy, cx + dx
                    if 0 <= a < on.shape[0] and 0 <= b < on.shape[1] and on[a, b] and not label[a, b]:
                        label[a, b] = n
                        todo.append((a, b))
    return label


def promoted(mask, least, corners):
    label = flood(mask == 2, corners)
    large = [k for k in range(1, label.max() + 1) if (label == k).sum() >= least]
    return np.where(np.isin(label, large), 3, mask), len(large)


@pytest.mark.parametrize("corners", [True, False])
def test_regions_equal_flood_fill(corners):
    rng = np.random.default_rng(4)
    for share in (0.2, 0.45, 0.6, 0.9):
        on = rng.random((23, 31)) < share
        row, start, end, label, area = regions.labelled(on, corners)
        want = flood(on, corners)
        got = np.zeros(on.shape, int)
        for r, s, e, k in zip(row, start, end, label, strict=True):
            got[r, s:e] = k + 1
        assert len(np.unique(got)) == len(np.unique(want))
        pairs = {(a, b) for a, b in zip(got.ravel(), want.ravel(), strict=True)}
        assert len(pairs) == len(np.unique(want))
        assert all((got == k + 1).sum() == a for k, a in zip(label, area, strict=True))


def test_a_large_spiral_is_one_region():
    n = 4096
    on = np.zeros((n, n), bool)
    a, b = 0, n - 1
    while a < b:
        on[a, max(0, a - 2) : b + 1] = on[a : b + 1, b] = on[b, a : b + 1] = on[a + 2 : b + 1, a] = True
        a, b = a + 2, b - 2
    began = time.perf_counter()
    label = regions.labelled(on, False)[3]
    assert (label == 0).all() and time.perf_counter() - began < 5


@pytest.mark.parametrize("corners", [True, False])
def test_tiles_equal_whole_frames(spark, corners):
    rng = np.random.default_rng(7)
    tiles, want = [], {}
    for k, share in ((1, 0.5), (None, 0.35), (3, 0.0)):
        mask = np.where(rng.random((14, 17)) < share, 2, rng.integers(0, 2, (14, 17)))
        want[k] = promoted(mask, 12, corners)[0]
        for ty, (y0, y1) in enumerate(((0, 5), (5, 6), (6, 14))):
            for tx, (x0, x1) in enumerate(((0, 4), (4, 11), (11, 17))):
                tiles.append((k, ty, tx, y1 - y0, x1 - x0, mask[y0:y1, x0:x1].ravel().tolist()))
    df = spark.createDataFrame(tiles, "f long, y int, x int, h int, w int, px array<int>").repartition(4)
    got = {k: np.zeros((14, 17), int) for k in want}
    for r in regions.promoted_tiles(df, "f", "y", "x", "h", "w", "px", least=12, corners=corners).collect():
        y, x = (0, 5, 6)[r["y"]], (0, 4, 11)[r["x"]]
        got[r["f"]][y : y + r["h"], x : x + r["w"]] = np.array(r["px"]).reshape(r["h"], r["w"])
    for k in want:
        assert (got[k] == want[k]).all()
    whole = spark.createDataFrame([(k, m.ravel().tolist()) for k, m in want.items()], "f long, px array<int>")
    assert regions.promoted_tiles(df.where("false"), "f", "y", "x", "h", "w", "px").count() == 0 and whole.count() == 3
