"""PNG masks against files made by hand, sizes, settings."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import frames, validation
from tidemark.sources import png, yaml_settings


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def paeth(a, b, c):
    return min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]


def filtered(lines, how, step):
    """Rows of bytes as a writer filters them."""
    out, above = b"", [0] * len(lines[0])
    for y, line in enumerate(lines):
        kind = how[y % len(how)]
        left = lambda x, row: row[x - step] if x >= step else 0
        guess = {0: lambda x: 0, 1: lambda x: left(x, line), 2: lambda x: above[x], 3: lambda x: (left(x, line) + above[x]) // 2, 4: lambda x: paeth(left(x, line), above[x], left(x, above))}[kind]
        out += bytes([kind]) + bytes((v - guess(x)) % 256 for x, v in enumerate(line))
        above = line
    return out


def packed(pixels, depth):
    if depth == 16:
        return [[b for v in row for b in (7, int(v))] for row in pixels]
    rows = []
    for row in pixels:
        bits = "".join(f"{int(v):0{depth}b}" for v in row)
        bits += "0" * (-len(bits) % 8)
        rows.append([int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)])
    return rows


def png_file(pixels, depth=8, colour=0, how=(0,), laced=False, channels=1, split=1):
    h, w = len(pixels), len(pixels[0])
    step = max(1, depth * channels // 8)
    if laced:
        raw = b"".join(filtered(packed([row[x::dx] for row in pixels[y::dy]], depth), how, step) for x, y, dx, dy in png.PASSES if len(pixels[0]) > x and len(pixels) > y)
    else:
        raw = filtered(packed(pixels, depth), how, step)
    body = zlib.compress(raw)
    cut = -(-len(body) // split)
    head = struct.pack(">IIBBBBB", w // channels, h, depth, colour, 0, 0, int(laced))
    palette = chunk(b"PLTE", bytes(range(48))) if colour == 3 else b""
    return png.SIGNATURE + chunk(b"IHDR", head) + palette + b"".join(chunk(b"IDAT", body[i : i + cut]) for i in range(0, len(body), cut)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("laced", [False, True])
@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
def test_every_filter_and_depth_comes_back(depth, laced):
    rng = np.random.default_rng(depth)
    for h, w in ((1, 1), (5, 3), (9, 17), (16, 8)):
        px = rng.integers(0, 1 << min(depth, 8), (h, w))
        for how in ((0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4), (4, 3, 2, 1)):
            got = png.mask(png_file(px.tolist(), depth, 0, how, laced, split=3))
            assert (got == px * {2: 85, 4: 17}.get(depth, 1)).all()
        if depth <= 8:
            assert (png.mask(png_file(px.tolist(), depth, 3, (1, 4), laced)) == px).all()


def test_other_files_fail():
    good = png_file([[1, 2], [3, 0]])
    rgb = png_file([[1, 2, 3] * 2], 8, 2, channels=3)
    for bad, said in ((rgb, "one channel"), (good[:-20], "within a chunk|broken"), (good[:-12], "no end"), (b"GIF89a", "no PNG"), (good[:30] + b"\0" + good[31:], "broken"), (png_file([[1]], how=(0,)).replace(b"IDAT", b"IDAT"), None)):
        if said:
            with pytest.raises(ValueError, match=said):
                png.mask(bad)
    short = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 9, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * 9)) + chunk(b"IEND", b"")
    with pytest.raises(ValueError, match="too few"):
        png.mask(short)


def test_masks_reach_the_class_operators(spark, tmp_path):
    px = np.array([[0, 1, 2], [3, 2, 9]])
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.png").write_bytes(png_file(px.tolist(), how=(4,)))
    made = png.masks(png.files(spark, str(tmp_path / "m")))
    row = made.first()
    assert (row["height"], row["width"], row["px"]) == (2, 3, px.ravel().tolist())
    pixels = made.select(F.explode("px").alias("cls"))
    assert {r["cls"]: r["n"] for r in validation.class_shares(pixels, ["cls"]).collect()} == {0: 1, 1: 1, 2: 2, 3: 1, 9: 1}
    classes = spark.createDataFrame([(i,) for i in range(4)], "id int")
    assert [(r["cls"], r["n"]) for r in validation.orphans(pixels, "cls", classes, "id").collect()] == [(9, 1)]
    assert made.select(frames.class_counts(F.col("px")).alias("c")).first()["c"]["coverage"] == pytest.approx(0.75)
    table = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 2)], "cls int, s int")
    assert {r["mapped"] for r in validation.mapped_labels(pixels, table, "cls", "s", "ignore").collect()} == {0, 1, 2, 255}


def test_sizes_must_agree(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 4, 6) + b"\x01\x01\x11\x00\xff\xd9"
    (tmp_path / "i.jpg").write_bytes(jpeg)
    (tmp_path / "m.png").write_bytes(png_file(np.ones((4, 6), int).tolist()))
    (tmp_path / "n.png").write_bytes(png_file(np.ones((4, 5), int).tolist()))
    found = png.files(spark, str(tmp_path), "*.{png,jpg}")
    images = png.sizes(found).withColumn("path", F.element_at(F.split("path", "/"), -1))
    assert sorted(tuple(r) for r in images.collect()) == [("i.jpg", 6, 4), ("m.png", 6, 4), ("n.png", 5, 4)]
    meta = spark.createDataFrame([("s1", "i.jpg", "m.png", 6, 4), ("s2", "i.jpg", "n.png", 5, None), ("s3", "gone.jpg", "m.png", 1, 1)], "sample_id string, image string, mask string, width int, height int")
    said = sorted(tuple(r) for r in png.size_findings(meta, images, images).collect())
    assert said == [("s2", "error", "mask is 5x4, image is 6x4"), ("s2", "error", "mask is 5x4, metadata says 5x-")]
    with pytest.raises(ValueError, match="neither"):
        png.size(b"BM")


YAML = """# classes
classes:
  - { id: 0, name: background }   # none
  - {id: 1, name: "water: #1", tags: [a, 'b''c', [1, 2.5]]}
ignore_index: 255
empty:
flag: true
off: No such
rate: -1.5e-3
"quoted key": '#x'
nested:
  a:
    - one
    - key: 1
      other: two words
    -
      - 3
  b: [1,
      2]
  note: >
    folded
    text # kept
  kept: |
    two
      lines
list:
- x
- y: ~
plain: goes
  on
"""


def test_settings_as_yaml(spark, tmp_path):
    want = {
        "classes": [{"id": 0, "name": "background"}, {"id": 1, "name": "water: #1", "tags": ["a", "b'c", [1, 2.5]]}], "ignore_index": 255, "empty": None, "flag": True, "off": "No such", "rate": -0.0015, "quoted key": "#x",
        "nested": {"a": ["one", {"key": 1, "other": "two words"}, [3]], "b": [1, 2], "note": "folded text # kept\n", "kept": "two\n  lines\n"}, "list": ["x", {"y": None}], "plain": "goes on",
    }
    assert yaml_settings.parsed(YAML) == want
    (tmp_path / "a.yaml").write_text(YAML)
    assert yaml_settings.settings(spark, str(tmp_path / "a.yaml"), ("classes",)) == json.loads(json.dumps(want))
    rows = yaml_settings.documents(spark, str(tmp_path)).select(F.from_json("json", "classes array<struct<id:int,name:string>>").alias("s")).first()
    assert [c["name"] for c in rows["s"]["classes"]] == ["background", "water: #1"]
    with pytest.raises(ValueError, match="lacks missing"):
        yaml_settings.settings(spark, str(tmp_path / "a.yaml"), ("missing",))
    assert yaml_settings.parsed("") is None and yaml_settings.parsed("{a: 1}") == {"a": 1}
    for bad in ("a: &x 1", "a: 1\na: 2", "just text", "a: [1, 2", "a:\n    b: 1\n  c: 2"):
        with pytest.raises(ValueError):
            yaml_settings.parsed(bad)


def test_reasons_of_polygons(spark):
    from tidemark.operators.masks import REASONS, polygons_reason

    ok = "[[0,0],[1,0],[1,1]]"
    many = "[" + ",".join(["[0,0]"] * 65) + "]"
    cases = {
        f'{{"roi":{ok},"structure":{ok}}}': None, "no json": REASONS["body"], "3": REASONS["body"], "null": REASONS["body"], '{"roi": 5}': "roi: " + REASONS["list"], f'{{"roi":{ok}}}': "structure: " + REASONS["list"],
        f'{{"roi":[[0,0],[1,1]],"structure":{ok}}}': "roi: " + REASONS["few"], f'{{"roi":{many},"structure":{ok}}}': "roi: " + REASONS["many"], f'{{"roi":{ok},"structure":[[0,0],[1],[1,1]]}}': "structure: " + REASONS["point"],
        f'{{"roi":[[0,0],[true,1],[2,1]],"structure":{ok}}}': "roi: " + REASONS["number"], f'{{"roi":[[0,0],["1",1],[1,1]],"structure":{ok}}}': "roi: " + REASONS["number"], f'{{"roi":[[0,0],[2,1],[1]],"structure":{ok}}}': "roi: " + REASONS["range"],
        f'{{"roi":[[0,0],[0.5,0.5],[1,1]],"structure":{ok}}}': "roi: " + REASONS["area"], '{"roi":[],"structure":[]}': "roi: " + REASONS["few"],
    }
    df = spark.createDataFrame([(c,) for c in cases], "b string")
    assert {r["b"]: r["why"] for r in df.select("b", polygons_reason(F.col("b")).alias("why")).collect()} == cases


def test_reason_of_an_area_on_the_limit_is_that_of_the_sql(spark, tmp_path):
    import duckdb

    from tidemark.plans.measures import DUCK, QUERIES

    corners = [0.366, 0.46, 0.266, 0.475, 0.406, 0.452]  # an area of 0.0001 but for rounding, which the order of the sum decides
    rows = [(4, [-0.5, -0.5, 0.5, -0.5, 0.5, 0.5, -0.5, 0.5, *[c - 0.5 for c in corners]])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = duckdb.sql(DUCK["polygon_reasons"].replace("FROM embeddings", f"FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")).fetchall()
    assert [tuple(r) for r in QUERIES["polygon_reasons"](spark, str(tmp_path)).collect()] == want


def test_warnings_of_unreviewed_labels(spark):
    rows = [("a", "pseudo_pending", False, False), ("b", "pseudo_pending", True, None), ("c", "pseudo_pending", True, True), ("d", "none", False, False), ("e", None, None, None)]
    made = validation.label_warnings(spark.createDataFrame(rows, "dataset string, water_source string, has_pseudolabels boolean, has_exclusions boolean"))
    assert [(r["scope"], r["message"].split()[-1]) for r in made.orderBy("scope").collect()] == [("a", "made"), ("b", "data")]


def test_annotated_names_are_resolved_to_files(spark, tmp_path):
    from tidemark.sources import adapters

    for f in ("loc1/a.jpg", "loc2/b.JPG", "c.png", "loc1/d.jpg", "loc2/d.jpg"):
        (tmp_path / "img" / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / f).write_bytes(b"x")
    doc = {"images": [{"id": i, "file_name": n, "width": 4, "height": 4} for i, n in enumerate(["a.jpg", "b.JPG", "c.png", "gone.jpg"])], "categories": [], "annotations": []}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    config = {"dataset": "d", "annotations": str(tmp_path / "c.json"), "images": str(tmp_path / "img")}
    names = lambda c: sorted((r["image"], r["sample_id"], r["group"]) for r in adapters.samples(spark, "coco_polygon", c).collect())
    assert names(config) == [("c.png", "c", "d")]
    assert names(config | {"recursive_images": True}) == [("c.png", "c", "d"), ("loc1/a.jpg", "loc1__a", "loc1"), ("loc2/b.JPG", "loc2__b", "loc2")]
    doc["images"][0]["file_name"] = "d.jpg"
    (tmp_path / "c.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="ambiguous file name"):
        names(config | {"recursive_images": True})
