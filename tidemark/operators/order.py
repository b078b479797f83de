"""Places in a global order, by columns of any type that can be ordered, without a group in one task.

Rows are dealt over ranges of the order, whose cuts Spark draws from a sample, and sorted there. They are written as they
lie, so that counts and places speak of the same ranges; the number of rows before each range, a row per range, is all
that is sent to every task. Ranges are cut by all columns, so rows that tie in the order asked for do not meet in one
range. Nulls come first. Rows that are equal in every column are interchangeable and stay together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .ranks import renamed, same

#: Groups whose sizes are sent to every task; those of more groups are joined by a shuffle.
SENT_GROUPS = 1_000_000


def _laid(df: DataFrame, order: Sequence[str | Column], ranges: int | None) -> DataFrame:
    """``df`` as written by ranges, with ``__range`` and the place ``__at`` (from 0) in it."""
    taken = {c for c in order if isinstance(c, str)}
    ties = [f.name for f in df.schema.fields if f.name not in taken and f.dataType.typeName() not in ("map", "variant")]
    keys = [*order, *ties]
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    rows = staged(dealt.sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()), "ordered")
    return rows.withColumns({"__range": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND((1 << 33) - 1)}).drop("__id")


def placed(df: DataFrame, order: Sequence[str | Column], out: str = "pos", first: int = 1, ranges: int | None = None) -> DataFrame:
    """``df`` with its place in the order, gapless from ``first`` over the whole table."""
    rows = _laid(df, order, ranges)
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = sizes.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    joined = rows.join(F.broadcast(base), F.col("__range") == F.col("__r"))
    return joined.select(*df.columns, (F.col("__base") + F.col("__at") + first).alias(out))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str = "at", size: str = "n", ranges: int | None = None) -> DataFrame:
    """``df`` with its place in its group's order, from 1, and the group's ``size``; null keys are one group."""
    rows = placed(df, [*group, *order], "__pos", 0, ranges)
    groups = renamed(staged(rows.groupBy(*group).agg(F.min("__pos").alias("__least"), F.count(F.lit(1)).alias("__size")), "groups"), group)
    sent = F.broadcast(groups) if groups.count() <= SENT_GROUPS else groups
    joined = rows.join(sent, same(rows, groups, group))
    return joined.select(*(rows[c] for c in df.columns), (F.col("__pos") - F.col("__least") + 1).alias(out), F.col("__size").alias(size))
