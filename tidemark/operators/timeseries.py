"""Operators on irregular series with missing values: rolling statistics, growth, streaks, carried values, nearest joins.

A missing value stays null everywhere; it never counts as zero.

Running values take a ``width``: the time of a bucket of the two-level scan in ``scans``, which spreads one key over many
tasks. Without it a key is one window in one task, which is quicker where keys are many and short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged
from . import scans


def rolling_nonnull(df: DataFrame, key: str, order: list[str], value: str, n: int, out: str, how: str = "median", width: float | None = None) -> DataFrame:
    """Median or mean of the last ``n`` values that are not null; a row with null shows the last result."""
    if width:
        return scans.rolling(df, [key], order, value, n, lambda v: F.percentile(v, F.lit(0.5)) if how == "median" else F.avg(v), width, out)
    w = Window.partitionBy(key).orderBy(*order)
    seen = df.withColumn("__nn", F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = Window.partitionBy(key).orderBy("__nn").rangeBetween(1 - n, 0)
    stat = F.percentile(value, F.lit(0.5)) if how == "median" else F.avg(value)
    return seen.withColumn(out, F.when(F.col("__nn") > 0, stat.over(last))).drop("__nn")


def growth(df: DataFrame, key: str, ts: str, value: str, window_s: int, out: str = "growth_per_min", width: float | None = None) -> DataFrame:
    """Change per minute against the oldest measured sample of the last ``window_s`` seconds, or the one before if there is none.

    ``ts`` rises strictly within a key. Rows without a value have no growth.
    """
    if width:
        return scans.growth(df, [key], ts, value, window_s, width, out)
    measured = F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(value).alias("f")))
    span = Window.partitionBy(key).orderBy(ts).rangeBetween(-window_s, 0)
    past = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.when(F.count(measured).over(span) >= 2, F.first(measured, ignorenulls=True).over(span)).otherwise(F.last(measured, ignorenulls=True).over(past))
    minutes = (F.col(ts) - F.col("__a.t")) / 60.0
    rate = F.when(F.col(value).isNotNull() & (minutes > 1e-6), (F.col(value) - F.col("__a.f")) / minutes)
    return df.withColumn("__a", anchor).withColumn(out, rate).drop("__a")


def streak(df: DataFrame, key: str, order: list[str], trigger: Column, out: str = "streak", width: float | None = None) -> DataFrame:
    """Consecutive triggered rows up to each row; any other row starts anew."""
    if width:
        return scans.run_lengths(df, [key], order, trigger, width, out)
    hit = F.coalesce(trigger, F.lit(False)).cast("int")
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("__hit", hit).withColumn("__run", F.sum(1 - F.col("__hit")).over(w))
    runs = Window.partitionBy(key, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(out, F.sum("__hit").over(runs)).drop("__hit", "__run")


def carried(df: DataFrame, key: str, order: list[str], value: Column, ts: str, out: str, age: str, width: float | None = None) -> DataFrame:
    """The last non-null ``value`` and its age in seconds."""
    if width:
        made = scans.running(df, [key], order, width, **{out: ("last", value), "__since": ("last", F.when(value.isNotNull(), F.col(ts)))})
        return made.withColumn(age, F.col(ts) - F.col("__since")).drop("__since")
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(value.isNotNull(), F.col(ts))
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w)).withColumn(age, F.col(ts) - F.last(at, ignorenulls=True).over(w))


def nearest(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, right_seq: str, tol_s: int, key: str | None = None) -> DataFrame:
    """Every row of ``left`` with the row of ``right`` nearest in time within ``tol_s`` seconds, else nulls; with ``key``, of the same device.

    Of equally near rows the earlier, then the one with the smaller ``right_seq`` wins. Time is cut into buckets as wide
    as the tolerance; rows of ``right`` also stand in the buckets beside their own. Within a bucket the last row before
    and the first after a time are running values, so a dense bucket costs a sort, not all its pairs.
    """
    bucket = lambda c: F.floor(F.col(c) / tol_s)
    device = (F.col(key) if key else F.lit(0)).alias("__k")
    ours = left.select(device, bucket(left_ts).alias("__b"), F.col(left_ts).alias("__t"), F.struct(*left.columns).alias("__l"))
    kept = [c for c in right.columns if c != key]
    theirs = right.select(device, F.explode(F.sequence(bucket(right_ts) - 1, bucket(right_ts) + 1)).alias("__b"), F.col(right_ts).alias("__t"), F.col(right_seq).alias("__q"), F.struct(*kept).alias("__r"))
    both = ours.unionByName(theirs, allowMissingColumns=True)
    near = lambda time: F.last("__r", ignorenulls=True).over(Window.partitionBy("__k", "__b").orderBy(time, F.col("__l").isNotNull(), F.desc("__q")).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumns({"__before": near(F.asc("__t")), "__after": near(F.desc("__t"))}).where("__l IS NOT NULL")
    gap = lambda side: F.abs(F.col("__t") - F.col(side)[right_ts])
    within = lambda side: F.when(gap(side) <= tol_s, F.col(side))
    best = F.when(gap("__before") <= F.coalesce(gap("__after"), gap("__before")), within("__before")).otherwise(within("__after"))
    return found.select("__l", best.alias("__m")).select("__l.*", *[F.col("__m")[c].alias(c) for c in kept])


def sliding_sum(df: DataFrame, at: str, value: str, width: int, bucket: int, out: str, key: list[str] | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the last ``width`` steps of ``at`` (whole numbers), the row's own among them.

    ``at`` is cut into buckets of ``bucket`` steps, ``width`` or more; rows near a bucket's end also stand in the next one.
    """
    if bucket < width:
        raise ValueError("a bucket holds a width at least")
    own = F.floor(F.col(at) / bucket)
    spread = df.withColumn("__own", own).withColumn("__b", F.explode(F.array_distinct(F.array(own, F.floor((F.col(at) + width - 1) / bucket)))))
    over = Window.partitionBy(*(key or []), "__b").orderBy(at).rangeBetween(1 - width, 0)
    return spread.withColumn(out, F.sum(value).over(over)).where("__b = __own").drop("__b", "__own")


def alerts(df: DataFrame, key: str, order: list[str], area: str, growth_col: str, area_from: float, growth_from: float, consecutive: int, width: float | None = None) -> DataFrame:
    """``df`` with the alert of a blockage: ``streak`` of rows over the area or the growth limit, ``alert`` from ``consecutive`` on, ``latched`` ever after, ``onset`` at its first row and the ``reason`` in words."""
    from ..functions.labels import alert_reason

    made = streak(staged(df, "alerts") if width else df, key, order, (F.coalesce(F.col(area) >= area_from, F.lit(False)) | F.coalesce(F.col(growth_col) >= growth_from, F.lit(False))), width=width)
    alert = F.col("streak") >= consecutive
    reason = F.when(alert, alert_reason(F.col(area), F.col(growth_col), area_from, growth_from)).otherwise("")
    if width:  # each level of the scan reads its input twice
        made = scans.running(staged(made, "streaks"), [key], order, width, latched=("any", alert))
    else:
        made = made.withColumn("latched", F.bool_or(alert).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return made.withColumns({"alert": alert, "onset": F.col("streak") == consecutive, "reason": reason})


def segments(df: DataFrame, key: str, order: list[str], starts: Column, out: str = "segment", width: float | None = None) -> DataFrame:
    """``df`` with the number of the segment that each row lies in; put it into the partitions of whatever must start anew."""
    if width:
        return scans.running(df, [key], order, width, **{out: ("sum", F.when(starts, 1).otherwise(0))})
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def latest_pair(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """One row (left, right): the latest row of each table as a struct, null if it has none."""
    newest = lambda df, order, name: df.agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias(name))
    return newest(left, left_order, "left").crossJoin(newest(right, right_order, "right"))  # one row each


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__m")).select("__m.*")


def verdict(frac: str, growth_col: str, alert: Column, threshold: float = 0.18) -> Column:
    """unknown, blocked, watch or clear."""
    return F.when(F.col(frac).isNull(), "unknown").when(alert | (F.col(frac) >= threshold), "blocked").when(F.coalesce(F.col(growth_col), F.lit(0.0)) > 0, "watch").otherwise("clear")


def minutes_to(frac: str, growth_col: str, threshold: float = 0.18) -> Column:
    return F.when((F.col(growth_col) > 0) & (F.col(frac) < threshold), (F.lit(threshold) - F.col(frac)) / F.col(growth_col))


def rain_outlook(blocks: DataFrame, key: str, order: str, hours: Column, mm: Column, least_mm: float = 0.5, first_hour: float = -3.0, last_hour: float = 24.0) -> DataFrame:
    """Per key the total of the forecast blocks from ``first_hour`` to ``last_hour``, and the first, in the order of ``order``, with ``least_mm`` or more.

    A block without a number does not count; a key without a block that counts has no total, which is not zero.
    """
    seen = blocks.withColumns({"__h": hours, "__mm": mm})
    counts = F.col("__h").between(first_hour, last_hour) & F.col("__mm").isNotNull()
    first = F.min_by(F.struct(F.col(order).alias("at"), F.col("__h").alias("hours"), F.col("__mm").alias("mm")), F.when(counts & (F.col("__mm") >= least_mm), F.col(order)))
    return seen.groupBy(key).agg(F.sum(F.when(counts, F.col("__mm"))).alias("total"), first.alias("rain"))


def payload(pair: DataFrame, now_s: Column, left_fields: dict[str, str], right_fields: dict[str, str], state: Column, notes: Column) -> DataFrame:
    """What an interface shows of a ``latest_pair``: both readings under the names wanted, the state and the notes, as one struct of structs."""
    side = lambda name, fields: F.when(F.col(name).isNotNull(), F.struct(*[F.col(f"{name}.{c}").alias(out) for c, out in fields.items()]))
    return pair.select(side("left", left_fields).alias("sensor"), side("right", right_fields).alias("camera"), state.alias("state"), notes.alias("notes"), now_s.alias("now_s"))


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``prefix`` before every column's name but those of ``keep``."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def prefixed_map(prefix: str, name: Column, keys: Column, values: Column) -> Column:
    """A map of ``values`` under keys of the prefix, a row's own ``name`` and ``keys``, such as val_<set>_<score>."""
    return F.map_from_entries(F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: F.struct(F.concat_ws("_", F.lit(prefix), name, x["k"]), x["v"])))
