"""Polygons and run lengths as column expressions; ``regions`` has connected regions, ``fill`` filled polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regions import promoted  # noqa: F401


def inside(polygon: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon (array of structs x, y) or on its edge."""
    n = F.size(polygon)
    nxt = lambda i: F.get(polygon, (i + 1) % n)
    cross = lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
    within = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))
    on_edge = F.exists(F.transform(polygon, lambda a, i: (cross(a, nxt(i)) == 0) & within(x, a["x"], nxt(i)["x"]) & within(y, a["y"], nxt(i)["y"])), lambda v: v)
    crossing = lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"])
    odd = F.size(F.filter(F.transform(polygon, lambda a, i: F.coalesce(crossing(a, nxt(i)), F.lit(False))), lambda v: v)) % 2 == 1
    return on_edge | odd


def polygon_area(polygon: Column) -> Column:
    """Area of a polygon; products are added and taken off one by one, as their order decides where an area lies on a limit."""
    n = F.size(polygon)
    terms = F.transform(polygon, lambda a, i: F.struct((a["x"] * F.get(polygon, (i + 1) % n)["y"]).alias("add"), (F.get(polygon, (i + 1) % n)["x"] * a["y"]).alias("off")))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v["add"] - v["off"])) / 2


def valid_polygon(polygon: Column) -> Column:
    """3 to 64 finite points in the unit square that enclose some area; others are rejected, not clipped."""
    fine = F.forall(polygon, lambda p: p["x"].between(0, 1) & p["y"].between(0, 1) & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    return F.coalesce(F.size(polygon).between(3, 64) & fine & (polygon_area(polygon) >= 1e-4), F.lit(False))


#: What is said of a polygon that is none.
REASONS = {"list": "bukan larik", "few": "minimal 3 titik", "many": "maksimal 64 titik", "point": "titik harus [x, y]", "number": "koordinat harus angka", "range": "koordinat harus di antara 0 dan 1", "area": "luas nyaris nol -- titik segaris?", "body": "body bukan objek"}


def _listed(value: Column) -> Column:
    """A variant as an array of variants; null if it is no list."""
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def polygon_reason(value: Column) -> Column:
    """Why a variant is no polygon ([[x, y], ...] in the unit square, see ``valid_polygon``): the first reason in the order of the checks, null if it is one."""
    points = _listed(value)

    def wrong(p: Column) -> Column:
        xy = _listed(p)
        kind = lambda i: F.schema_of_variant(F.get(xy, F.lit(i)))
        number = lambda i: kind(i).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
        at = lambda i: F.try_variant_get(F.get(xy, F.lit(i)), "$", "double")
        finite = lambda i: number(i) & (F.abs(at(i)) < float("inf"))
        return (
            F.when(xy.isNull() | (F.size(xy) != 2), REASONS["point"])
            .when(~F.coalesce(finite(0) & finite(1), F.lit(False)), REASONS["number"])
            .when(~(at(0).between(0, 1) & at(1).between(0, 1)), REASONS["range"])
        )

    corners = F.transform(points, lambda p: F.struct(F.try_variant_get(p, "$[0]", "double").alias("x"), F.try_variant_get(p, "$[1]", "double").alias("y")))
    first = F.get(F.filter(F.transform(points, wrong), lambda w: w.isNotNull()), F.lit(0))
    return (
        F.when(points.isNull(), REASONS["list"])
        .when(F.size(points) < 3, REASONS["few"])
        .when(F.size(points) > 64, REASONS["many"])
        .when(first.isNotNull(), first)
        .when(polygon_area(corners) < 1e-4, REASONS["area"])
    )


def polygons_reason(body: Column) -> Column:
    """Why a JSON text is no pair of polygons ``roi`` and ``structure``; the part that is wrong stands before its reason, null if all is well."""
    made = F.try_parse_json(body)
    part = lambda name: F.concat(F.lit(f"{name}: "), F.coalesce(polygon_reason(F.try_variant_get(made, f"$.{name}", "variant")), F.when(F.try_variant_get(made, f"$.{name}", "variant").isNull(), REASONS["list"])))
    shaped = F.coalesce(F.schema_of_variant(made).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    return F.when(~shaped, REASONS["body"]).otherwise(F.coalesce(part("roi"), part("structure")))


def run_lengths(text: Column) -> Column:
    """Run lengths of the compressed text form: null stays null, an empty text has none.

    A number is written five bits a character from the lowest up, as character 48 plus the bits; 32 says that more
    follow, and 16 in the last character that the number is negative. From the fourth on, numbers are differences to
    the one before the last.
    """
    parts = F.regexp_extract_all(text, F.lit("([P-o]*[0-O])"), 1)
    bits = lambda c: F.ascii(c) - 48

    def number(part: Column) -> Column:
        chars = F.transform(F.sequence(F.lit(1), F.length(part)), lambda k: bits(F.substr(part, k, F.lit(1))).cast("bigint"))
        sums = F.aggregate(F.transform(chars, lambda v, i: (v % 32) * F.pow(F.lit(32.0), i).cast("bigint")), F.lit(0).cast("bigint"), lambda s, v: s + v)
        return F.when(F.element_at(chars, -1) >= 16, sums - F.pow(F.lit(32.0), F.size(chars)).cast("bigint")).otherwise(sums)

    start = F.array().cast("array<bigint>")
    grown = lambda out, d: F.array_append(out, d + F.when(F.size(out) > 2, F.element_at(out, -2)).otherwise(F.lit(0)))
    return F.aggregate(F.transform(parts, number), start, grown)


def run_mask(counts: Column, height: Column, width: Column) -> Column:
    """The mask by rows (0 and 1) of run lengths that go down the columns and begin with zeros; other sizes than height x width are null."""
    down = F.flatten(F.transform(counts, lambda c, i: F.array_repeat((i % 2).cast("int"), c.cast("int"))))
    by_row = F.transform(F.sequence(F.lit(0), height * width - 1), lambda p: F.get(down, ((p % width) * height + F.floor(p / width)).cast("int")))
    return F.when((height * width > 0) & (F.size(down) == height * width), by_row)
