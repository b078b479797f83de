"""Exact ranks, percentiles and heads of numbers without a whole group in one task.

Values are counted first, then dealt over ranges whose cuts are approximate quantiles. The cuts only decide where work is done: counts of
the ranges, a few rows, tell where each range begins, so results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged

#: Distinct values of a range; how many ranges there are follows from how many values were counted.
RANGE_ROWS = 1_000_000


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Equal in all ``columns``, nulls among them."""
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[f"__{c}"]) for c in columns), F.lit(True))


def renamed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(c).alias(f"__{c}" if c in columns else c) for c in df.columns))


def below(cuts: Column, value: Column, most: int) -> Column:
    """How many of at most ``most`` sorted ``cuts`` lie below ``value``, by halving; null counts as below all."""
    halves = F.sequence(F.lit(1), F.lit(max(1, most.bit_length())))
    start = F.struct(F.lit(0).alias("lo"), F.coalesce(F.size(cuts), F.lit(0)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        less = (s["lo"] < s["hi"]) & F.coalesce(F.get(cuts, mid) < value, F.lit(False))
        return F.struct(F.when(less, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(less | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(halves, start, step, lambda s: s["lo"])


def dealt(df: DataFrame, group: Sequence[str], value: str, ranges: int) -> DataFrame:
    """``df`` with ``__range``, which rises with the number ``value`` within a group; nulls come first."""
    if ranges < 2:
        return df.withColumn("__range", F.lit(0))
    cuts = df.groupBy(*group).agg(F.percentile_approx(value, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), max(1000, 4 * ranges)).alias("__cuts"))
    cuts = renamed(cuts, group)
    return df.join(cuts, same(df, cuts, group), "left").select(*df.columns, below(F.col("__cuts"), F.col(value), ranges).alias("__range"))


def nearest_ranks(df: DataFrame, group: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]], ranges: int | None = None) -> DataFrame:
    """A row per group: ``n`` values that are not null, and for each name the value at a zero-based rank that follows from ``n``."""
    counted = staged(df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c")), "counted")
    counted = dealt(counted, group, value, ranges or -(-counted.count() // RANGE_ROWS))
    sizes = counted.groupBy(*group, "__range").agg(F.sum("__c").alias("__size"))
    by_range = Window.partitionBy(*group).orderBy("__range")
    sizes = sizes.select(*group, "__range", F.coalesce(F.sum("__size").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"), F.sum("__size").over(Window.partitionBy(*group)).alias("__n"))
    keys = [*group, "__range"]
    sizes = renamed(sizes, keys)
    joined = counted.join(sizes, same(counted, sizes, keys)).select(*counted.columns, "__base", "__n")
    upto = F.col("__base") + F.sum("__c").over(Window.partitionBy(*keys).orderBy(value))
    placed = joined.withColumn("__upto", upto)
    picked = []
    for name, rank in ranks.items():
        wanted = rank(F.col("__n"))
        picked.append(F.max(F.when((wanted < F.col("__upto")) & (wanted >= F.col("__upto") - F.col("__c")), F.col(value))).alias(name))
    return placed.groupBy(*group).agg(F.max("__n").alias("n"), *picked)


def percentiles(df: DataFrame, group: Sequence[str], value: str, shares: dict[str, float], ranges: int | None = None) -> DataFrame:
    """A row per group: ``n`` values that are not null, and for each name the percentile at a share, between the two nearest ranks in proportion."""
    at = lambda p, n: F.lit(float(p)) * (n - 1)
    picks = {}
    for name, p in shares.items():
        picks[f"__lo_{name}"] = lambda n, p=p: F.floor(at(p, n))
        picks[f"__hi_{name}"] = lambda n, p=p: F.ceil(at(p, n))
    found = nearest_ranks(df, group, value, picks, ranges)

    def between(name: str, p: float) -> Column:
        place, lo, hi = at(p, F.col("n")), F.col(f"__lo_{name}").cast("double"), F.col(f"__hi_{name}").cast("double")
        return F.when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi).alias(name)

    return found.select(*group, "n", *[between(name, p) for name, p in shares.items()])


def positions(df: DataFrame, lead: Sequence[str], value: str, out: str = "pos", first: int = 1) -> DataFrame:
    """``df`` with its position in the order of ``lead``, then ``value`` (nulls first): gapless over the whole table."""
    from .order import placed

    return placed(df, [*lead, value], out, first)


def heads(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; each task keeps ``n`` of a group before the shuffle."""
    return df.withColumn("__at", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__at") <= n).drop("__at")


def at_share(p: float) -> Callable[[Column], Column]:
    """The rank floor(p * n), at most the last."""
    return lambda n: F.least(n - 1, F.floor(F.lit(p) * n))


def upper_middle(n: Column) -> Column:
    """The rank of the middle, of two the upper one."""
    return F.floor(n / 2)


def last(n: Column) -> Column:
    return n - 1


def first(n: Column) -> Column:
    return F.lit(0)
