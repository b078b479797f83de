"""Boxes, polygons, paths and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def denormalised(polygon: Column, width: Column, height: Column) -> Column:
    """Points (x, y) of the unit square in pixels of a frame: 1 is the last pixel."""
    return F.transform(polygon, lambda p: F.struct((p["x"] * (width - 1)).alias("x"), (p["y"] * (height - 1)).alias("y")))


def rounded(polygon: Column) -> Column:
    """Points on whole pixels, halves to the even one."""
    return F.transform(polygon, lambda p: F.struct(F.bround(p["x"]).alias("x"), F.bround(p["y"]).alias("y")))


def resized(width: Column, height: Column, longest: int) -> Column:
    """(width, height) of a frame whose longer side becomes ``longest``; neither becomes zero."""
    side = lambda n: F.greatest(F.lit(1), F.bround(n * F.lit(float(longest)) / F.greatest(width, height)).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def kept_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a box is complete and has an inside."""
    return F.coalesce((x2 > x1) & (y2 > y1), F.lit(False))


def area_in(pixels: Column, units: str = "px") -> Column:
    """An area in the units of the site's geometry. Only pixels are known; a metric geometry fails the query that reads it."""
    return pixels.cast("double") if units == "px" else F.raise_error(F.lit(f"no conversion to {units}")).cast("double")


def colour(key: Column) -> Column:
    """24-bit number of a colour written ``R,G,B``; null if it is not three numbers up to 255."""
    parts = F.transform(F.split(key, ","), lambda x: F.trim(x).try_cast("int"))
    ok = (F.size(parts) == 3) & F.forall(parts, lambda x: x.between(0, 255))
    return F.when(ok, F.get(parts, F.lit(0)) * 65536 + F.get(parts, F.lit(1)) * 256 + F.get(parts, F.lit(2)))


def sample_id(path: Column) -> Column:
    """A relative path as an id."""
    return F.replace(path, F.lit("/"), F.lit("__"))


def head_and_tail(entry: Column) -> Column:
    """(head, tail) of an entry at its first slash; without one all is head."""
    at = F.instr(entry, "/")
    return F.struct(F.when(at > 0, F.substring(entry, F.lit(1), at - 1)).otherwise(entry).alias("head"), F.when(at > 0, F.substring(entry, at + 1, F.length(entry))).when(entry.isNotNull(), "").alias("tail"))


def last_part(path: Column) -> Column:
    """The file name of a path."""
    return F.element_at(F.split(path, "/"), -1)


def without_ending(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def speed(u: Column, v: Column, scale: Column, dt_s: Column) -> Column:
    """Pixels a second, in the original frame, of a motion found in a frame scaled down by ``scale``; null without time."""
    return F.when(dt_s > 0, F.sqrt(u * u + v * v) / F.greatest(F.lit(1e-9), scale) / dt_s)
