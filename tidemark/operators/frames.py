"""Frames as arrays of classes by rows: counts within regions, overlays, lookups, motion.

A frame is one row; null and empty frames have no pixels, and shares of nothing are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area_in, denormalised, rounded
from .fill import polygon_pixels
from .timeseries import rolling_nonnull

#: Classes of a pixel.
BACKGROUND, WATER, DEBRIS, CLUMP = 0, 1, 2, 3


def within(px: Column, region: Column, empty: str = "whole") -> Column:
    """The pixels inside ``region`` (array of booleans). A null region is the whole frame, or with ``empty`` = none no pixel."""
    chosen = F.filter(px, lambda p, i: F.coalesce(F.get(region, i), F.lit(False)))
    return F.coalesce(F.when(region.isNotNull(), chosen).otherwise(px if empty == "whole" else F.filter(px, lambda p: F.lit(False))), F.array().cast("array<int>"))


def counted(px: Column, *classes: int) -> Column:
    return F.size(F.filter(px, lambda p: p.isin(*classes))).cast("long")


def region_px(region: Column) -> Column:
    return F.size(F.filter(region, lambda r: r)).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def frame_metrics(frames: DataFrame, px: str, roi: str, structure: str, units: str = "px") -> DataFrame:
    """``frames`` with counts per frame: debris, water and coverage inside ``roi``, accumulated debris before the ``structure`` inside it.

    No region of interest is the whole frame, no structure no pixel. Coverage is null where there is neither debris nor
    water; accumulation is a share of the structure's pixels, which count as one at least.
    """
    everything = within(F.col(px), F.col(roi))
    both = F.when(F.col(roi).isNull(), F.col(structure)).otherwise(F.zip_with(F.col(structure), F.col(roi), lambda s, r: s & r))
    shape = F.struct(
        counted(everything, DEBRIS, CLUMP).alias("debris_px"),
        counted(everything, WATER).alias("water_px"),
        F.size(everything).cast("long").alias("roi_px"),
        counted(within(F.col(px), both, "none"), DEBRIS, CLUMP).alias("accumulation_px"),
        F.coalesce(region_px(both), F.lit(0)).alias("structure_px"),
    )
    made = frames.withColumn("__m", F.when(F.col(px).isNotNull(), shape)).select(*frames.columns, "__m.*")
    return made.withColumns({
        "coverage": ratio(F.col("debris_px"), F.col("debris_px") + F.col("water_px")),
        "accumulation_frac": ratio(F.col("accumulation_px"), F.greatest(F.lit(1), F.col("structure_px"))),
        "debris_area": area_in(F.col("debris_px"), units),
        "accumulation_area": area_in(F.col("accumulation_px"), units),
    })


def class_counts(px: Column) -> Column:
    """Debris, water, background, coverage and the share of water of a frame."""
    debris, water = counted(px, DEBRIS, CLUMP), counted(px, WATER)
    return F.struct(debris.alias("debris"), water.alias("water"), counted(px, BACKGROUND).alias("background"), ratio(debris, debris + water).alias("coverage"), ratio(water, F.size(px)).alias("water_share"))


def overlaid(water: Column, debris: Column) -> Column:
    """One frame of a water and a debris mask (0 and 1); debris wins."""
    return F.zip_with(water, debris, lambda w, d: F.when(d == 1, DEBRIS).when(w == 1, WATER).otherwise(BACKGROUND))


def classified(scores: Column, cuts: Sequence[tuple[float, int]], default: int) -> Column:
    """Classes of scores: that of the first cut that is exceeded."""

    def of(x: Column) -> Column:
        out = F.lit(default)
        for cut, cls in reversed(cuts):
            out = F.when(x > cut, cls).otherwise(out)
        return out

    return F.transform(scores, of)


def mapped(px: Column, table: Sequence[int]) -> Column:
    """Each pixel's class by a lookup table; a class that the table lacks is null."""
    return F.transform(px, lambda p: F.get(F.array(*[F.lit(x) for x in table]), p))


def composed(first: Sequence[int], second: Sequence[int]) -> list[int]:
    """The table that does what ``first`` does, then ``second``."""
    return [second[x] for x in first]


def arg_max(scores: Column) -> Column:
    """The place of the largest score, of equals the first."""
    return F.array_position(scores, F.array_max(scores)) - 1


def polygon_mask(polygon: Column, width: int, height: int) -> Column:
    """Booleans by rows: the pixels of a polygon of the unit square, its edge included. Null stays null."""
    return polygon_pixels(rounded(denormalised(polygon, F.lit(width), F.lit(height))), width, height)


def union_area(instances: DataFrame, frame: Sequence[str], px: str) -> DataFrame:
    """Pixels covered by any instance of a frame, and the sum over instances; a row of ``instances`` is a pixel."""
    return instances.groupBy(*frame).agg(F.count_distinct(px).alias("union_px"), F.count(F.lit(1)).alias("instance_px"))


def painted(shapes: DataFrame, pixel: Sequence[str], label: str, priority: Sequence[str]) -> DataFrame:
    """The label that is painted last on each pixel: the one of the highest priority."""
    return shapes.groupBy(*pixel).agg(F.max_by(label, F.struct(*priority)).alias("painted"))


def moving(vectors: DataFrame, u: str, v: str, in_debris: Column, least: float) -> DataFrame:
    """Motion vectors longer than ``least`` inside debris."""
    return vectors.where((F.sqrt(F.col(u).cast("double") ** 2 + F.col(v).cast("double") ** 2) > least) & in_debris)


def intervals(df: DataFrame, key: str, order: Sequence[str], micros: Column, nominal: float, out: str = "dt_s") -> DataFrame:
    """Seconds since the row before, ``nominal`` for the first, a millionth at least; times are whole microseconds."""
    before = F.lag(micros).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn(out, F.greatest(F.lit(1e-6), F.coalesce((micros - before) / F.lit(1e6), F.lit(nominal))))


def velocities(df: DataFrame, key: str, order: list[str], raw: str, n_vectors: str, dt: str, n: int = 15) -> DataFrame:
    """``df`` with the median of the last ``n`` velocities that count, to three places: those of a frame with vectors and time."""
    pushed = df.withColumn("__v", F.when((F.col(n_vectors) > 0) & (F.col(dt) > 0), F.col(raw)))
    made = rolling_nonnull(pushed, key, order, "__v", n, "velocity_px_s").withColumn("raw_px_s", F.bround("__v", 3))
    return made.withColumn("velocity_px_s", F.bround("velocity_px_s", 3)).drop("__v")


def clipped(df: DataFrame, group: Sequence[str], channels: Sequence[str], level: float, share: float) -> DataFrame:
    """Whether more than ``share`` of a group's pixels have all channels at ``level`` or above."""
    full = F.lit(True)
    for c in channels:
        full = full & (F.col(c) >= level)
    return df.groupBy(*group).agg((F.avg(full.cast("double")) > share).alias("clipped"))


def exposure_choice(df: DataFrame, step: str, order: Sequence[str], luminance: str, aim: float) -> DataFrame:
    """One row: the exposure whose first measured luminance is nearest to ``aim``, of equals the smallest step."""
    firsts = df.groupBy(step).agg(F.min_by(luminance, F.struct(*order)).alias("lum"))
    best = F.min(F.struct(F.abs(F.col("lum") - aim).alias("d"), F.col(step)))
    return firsts.agg(best.alias("m")).where("m IS NOT NULL").select(f"m.{step}", "m.d")


def luminances(df: DataFrame, step: str, value: str, order: Sequence[str], most: int = 5) -> DataFrame:
    """Median of the first ``most`` luminances of each step."""
    from .ranks import heads

    return heads(df, [step], order, most).groupBy(step).agg(F.median(value).alias("luminance"))  # of ``most`` values
