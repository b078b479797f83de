"""Running values of one key over many tasks: a scan in two levels.

Time is cut into buckets. Each bucket of a key is summed up by itself; the summaries, a row per key and bucket, are
scanned in order, and what lies before a bucket stands as a first row in it. So no task holds more of a key than one
bucket, however many rows the key has, and the rows are those of one window over the whole key.

The first column of ``order`` is a number, ``width`` is a bucket's width in it; a null stands before all numbers, in a
bucket of its own. Null keys are one key. Rows equal in all of ``order`` have no order among them, as in any window.
The input is read twice, once for the summaries, which need few of its columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import sent
from .ranks import renamed, same

#: Rows of a bucket that ``width_for`` aims at.
BUCKET_ROWS = 1_000_000


def width_for(df: DataFrame, key: Sequence[str], at: str, rows: int = BUCKET_ROWS) -> float:
    """A bucket's width that holds about ``rows`` rows of the densest key; one job that reads the key and ``at``."""
    spans = df.groupBy(*key).agg(F.count(at).alias("n"), (F.max(at) - F.min(at)).cast("double").alias("span"))
    return spans.agg(F.min(F.when((F.col("n") > rows) & (F.col("span") > 0), F.col("span") * rows / F.col("n")))).first()[0] or float("inf")


def bucket(at: str, width: float) -> Column:
    """The number of a bucket; with an infinite width all numbers share one."""
    return F.floor(F.col(at) / F.lit(float(width))).alias("__b")


_TOGETHER = {"sum": F.sum, "any": F.bool_or, "max": F.max}


def _summary(kind: str, value: Column, order: Sequence[str]) -> Column:
    """A bucket's value of a kind."""
    kind = kind.removesuffix("_before")
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order))) if kind == "last" else _TOGETHER[kind](value)


def _running(kind: str, value: Column, window) -> Column:
    kind = kind.removesuffix("_before")
    return (F.last(value, ignorenulls=True) if kind == "last" else _TOGETHER[kind](value)).over(window)


def running(df: DataFrame, key: Sequence[str], order: Sequence[str], width: float, **values: tuple[str, Column]) -> DataFrame:
    """``df`` with running values by name, each of a kind and a column.

    Kinds: ``sum``, ``max``, ``any`` and ``last`` (the last that is not null) up to the row, and the same with ``_before``
    before it, null where nothing is.
    """
    given = {name: f"__v_{name}" for name in values}
    rows = df.select(*df.columns, bucket(order[0], width), *[v.alias(given[name]) for name, (_, v) in values.items()])
    sums = rows.groupBy(*key, "__b").agg(*[_summary(kind, F.col(given[name]), order).alias(given[name]) for name, (kind, _) in values.items()])
    earlier = Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    carry = sums.select(*key, "__b", *[_running(kind, F.col(given[name]), earlier).alias(given[name]) for name, (kind, _) in values.items()])
    both = rows.withColumn("__row", F.lit(1)).unionByName(carry.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*key, "__b").orderBy("__row", *order)
    span, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    made = both.withColumns({name: _running(kind, F.col(given[name]), before if kind.endswith("_before") else span) for name, (kind, _) in values.items()})
    return made.where("__row = 1").select(*df.columns, *values)


def run_lengths(df: DataFrame, key: Sequence[str], order: Sequence[str], hit: Column, width: float, out: str) -> DataFrame:
    """``df`` with the number of consecutive rows where ``hit`` holds, up to each row.

    A bucket without a miss adds to the run that reaches it; one with a miss starts anew with its last rows.
    """
    rows = df.withColumn("__hit", F.coalesce(hit, F.lit(False)).cast("int")).withColumn("__b", bucket(order[0], width))
    w = Window.partitionBy(*key, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("__misses", F.sum(1 - F.col("__hit")).over(w))
    local = local.withColumn("__run", F.sum("__hit").over(Window.partitionBy(*key, "__b", "__misses").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy(*key, "__b").agg(F.max_by("__run", F.struct(*order)).alias("__end"), (F.max("__misses") > 0).cast("int").alias("__broke"))
    by = Window.partitionBy(*key).orderBy("__b")
    since = ends.withColumn("__since", F.sum("__broke").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    upto = since.withColumn("__upto", F.sum("__end").over(Window.partitionBy(*key, "__since").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)))
    keys = [*key, "__b"]
    carry = renamed(upto.select(*keys, F.lag("__upto", 1, 0).over(by).alias("__carry")), keys)
    joined = local.join(carry, same(local, carry, keys))
    length = F.when(F.col("__hit") == 0, 0).otherwise(F.col("__run") + F.when(F.col("__misses") == 0, F.col("__carry")).otherwise(0))
    return joined.select(*(local[c] for c in df.columns), length.alias(out))


def _spread(df: DataFrame, at: str, width: int, size: int, counts: Column) -> DataFrame:
    """``df`` with a row's own bucket and ``__b``, in which it stands: its own and, if it ``counts`` and the next reaches back to it, that one."""
    own = F.floor(F.col(at) / size)
    places = F.when(counts, F.array_distinct(F.array(own, F.floor((F.col(at) + width) / size)))).otherwise(F.array(own))
    return df.withColumn("__own", own).withColumn("__b", F.explode(places))


def over_last(df: DataFrame, key: Sequence[str], at: str, width: int, size: int, counts: Column, made: Callable[[object], Column], out: str) -> DataFrame:
    """``df`` with ``made`` of a window over the last ``width`` units of the number ``at``, the row's own among them.

    Buckets are ``size`` wide, ``width`` at least; rows that ``counts`` near a bucket's end stand in the next one too.
    """
    spread = _spread(df, at, width, max(size, width), counts)
    over = Window.partitionBy(*key, "__b").orderBy(at).rangeBetween(-width, 0)
    return spread.withColumn(out, made(over)).where("__b <=> __own").drop("__b", "__own")


def rolling(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, n: int, stat: Callable[[str], Column], width: float, out: str, size: int = 65_536) -> DataFrame:
    """``df`` with ``stat`` of the last ``n`` values that are not null; a row with null shows the last result.

    A running count numbers the values; the frames are laid out anew by that number, ``size`` of them to a task.
    """
    counted = running(df, key, order, width, __nn=("sum", F.col(value).isNotNull().cast("long")))
    made = over_last(counted, key, "__nn", n - 1, size, F.col(value).isNotNull(), lambda w: stat(value).over(w), out)
    return made.withColumn(out, F.when(F.col("__nn") > 0, F.col(out))).drop("__nn")


def growth(df: DataFrame, key: Sequence[str], ts: str, value: str, window_s: int, width: float, out: str) -> DataFrame:
    """Change per minute against the oldest measured sample of the last ``window_s`` seconds, or the one before if there is none.

    Both look back in the same buckets, so rows are sent and sorted once; what stands before a bucket is joined to it.
    """
    size = max(window_s, int(min(width, 1e15)))
    own = F.floor(F.col(ts) / size)
    measured = F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(value).alias("f")))
    ends = df.groupBy(*key, own.alias("__b")).agg(_summary("last", measured, [ts]).alias("__end"))
    earlier = Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    keys = [*key, "__b"]
    carry = sent(renamed(ends.select(*keys, _running("last", F.col("__end"), earlier).alias("__carry")), keys), "carry")
    spread = _spread(df, ts, window_s, size, F.col(value).isNotNull())
    rows = spread.join(carry, same(spread, carry, keys), "left").select(*(spread[c] for c in spread.columns), "__carry")
    by = Window.partitionBy(*keys).orderBy(ts)
    near, past = by.rangeBetween(-window_s, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(_running("last", measured, past), F.col("__carry"))
    made = rows.withColumn("__a", F.when(F.count(measured).over(near) >= 2, F.first(measured, ignorenulls=True).over(near)).otherwise(last))
    minutes = (F.col(ts) - F.col("__a.t")) / 60.0
    rate = F.when(F.col(value).isNotNull() & (minutes > 1e-6), (F.col(value) - F.col("__a.f")) / minutes)
    return made.where("__own <=> __b").withColumn(out, rate).drop("__a", "__carry", "__own", "__b")
