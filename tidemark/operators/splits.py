"""Splits of grouped samples, their checks, and samplers. Every choice follows from a seed and md5, never from row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import sent
from .order import numbered
from .ranks import heads, renamed, same


def seeded(seed: int, *parts: str) -> Column:
    """md5 of ``seed:part:...``: a stable random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def group_order(df: DataFrame, dataset: str, group: str, seed: int) -> DataFrame:
    """Each dataset's groups with their position in seeded order."""
    groups = df.select(dataset, group).distinct()
    return groups.withColumn("pos", F.row_number().over(Window.partitionBy(dataset).orderBy(seeded(seed, dataset, group))))


def hashed_split(df: DataFrame, seed: int, parts: Sequence[str], shares: Sequence[tuple[str, int]]) -> DataFrame:
    """``df`` with ``split`` by the first hex digit of the seeded hash: so many sixteenths each, in order."""
    digit = F.conv(F.substring(seeded(seed, *parts), 1, 1), 16, 10).cast("int")
    out, upto = F.lit(None).cast("string"), sum(n for _, n in shares)
    for name, n in reversed(shares):
        out = F.when(digit < upto, name).otherwise(out)
        upto -= n
    return df.withColumn("split", out)


def split_counts(df: DataFrame, dataset: str, group: str, split: str = "split") -> DataFrame:
    """Samples and groups of each split."""
    return df.groupBy(dataset, split).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("n_groups"))


def split_deviation(df: DataFrame, dataset: str, ratios: dict[str, float], most: float = 0.15, split: str = "split") -> DataFrame:
    """Each split's distance from its wanted share, and whether that is too far. A split without samples is there with none."""
    spark = df.sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(ratios.items()), f"{split} string, __want double"))
    every = df.select(dataset).distinct().crossJoin(wanted)  # a row per wanted split
    counts = renamed(df.groupBy(dataset, split).agg(F.count(F.lit(1)).alias("n")), [dataset, split])
    made = every.join(counts, same(every, counts, [dataset, split]), "left").select(dataset, split, "__want", F.coalesce("n", F.lit(0)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(dataset)).cast("double")
    made = made.withColumn("dev", F.round(F.abs(share - F.col("__want")), 9))
    return made.select(dataset, split, "n", "dev", (F.col("dev") > most).alias("warned"), (F.col("n") == 0).alias("empty"))


def straddling(df: DataFrame, group: Sequence[str], split: str = "split") -> DataFrame:
    """Groups that stand in more than one split: leaks."""
    return df.groupBy(*group).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def in_both(df: DataFrame, one: str, other: str, group: str, split: str = "split") -> DataFrame:
    """Groups of split ``one`` that ``other`` has too."""
    pick = lambda name: df.where(F.col(split) == name).select(group)
    return pick(one).intersect(pick(other))


def only_in(df: DataFrame, one: str, other: str, group: str, split: str = "split") -> DataFrame:
    """Groups of split ``one`` that ``other`` lacks."""
    pick = lambda name: df.where(F.col(split) == name).select(group)
    return pick(one).subtract(pick(other))


def held_out(*parts: DataFrame) -> DataFrame:
    """The set of all ids of ``parts``."""
    return merged(*parts).distinct()


def merged(*parts: DataFrame) -> DataFrame:
    """The bag of all rows of ``parts``."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def location_folds(df: DataFrame, location: str) -> DataFrame:
    """Leave one location out: rows (test_loc, val_loc, train_loc); val is the next location in order, after the last the first.

    Places are few; the order runs over their names alone.
    """
    places = df.select(location).distinct()
    ring = Window.orderBy(location)
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    folds = places.select(F.col(location).alias("test_loc"), F.coalesce(F.lead(location).over(ring), F.first(location).over(whole)).alias("val_loc"))
    rest = places.select(F.col(location).alias("train_loc"))
    return sent(folds, "folds").join(rest, (F.col("train_loc") != F.col("test_loc")) & (F.col("train_loc") != F.col("val_loc")))


def without_ids(df: DataFrame, ids: DataFrame, key: Sequence[str]) -> DataFrame:
    """``df`` without the rows whose key ``ids`` names: exclusions, or what an earlier run has done."""
    return df.join(ids.select(*key).distinct(), list(key), "left_anti")


def dangling(entries: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """``entries`` with the columns of ``known`` (one row per key) and whether there is none."""
    right = renamed(known.withColumn("__there", F.lit(True)), key)
    joined = entries.join(right, same(entries, right, key), "left")
    return joined.select(*entries.columns, *(c for c in known.columns if c not in key), F.col("__there").isNull().alias("dangling"))


def weighted(df: DataFrame, weights: DataFrame, key: str, weight: str, default: float = 1.0) -> DataFrame:
    """``df`` with the weight of its key, ``default`` where none is given."""
    return df.join(weights.select(key, F.col(weight).cast("double").alias("weight")), key, "left").withColumn("weight", F.coalesce("weight", F.lit(default)))


def capped(df: DataFrame, group: str, key: str, quota: Column, seed: int) -> DataFrame:
    """``quota`` rows of each group without replacement (at least one, at most all), drawn by seed; ``n`` in ``quota`` is the group's size."""
    made = numbered(df.withColumn("__draw", seeded(seed, key)), [group], ["__draw", key], "__at", "n")
    return made.where(F.col("__at") <= F.greatest(F.lit(1), F.least("n", quota))).select(*df.columns)


def every_kth(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int, most: int | None = None) -> DataFrame:
    """Each group's first row and every k-th after it, ``most`` of them at most."""
    made = numbered(df, group, order, "__at", "__size").withColumn("__step", (F.col("__at") - 1) / k)
    kept = made.where((F.col("__at") - 1) % k == 0)
    return (kept if most is None else kept.where(F.col("__step") < most)).select(*df.columns)


def checked_sample(df: DataFrame, group: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """About ``most`` rows of each larger group, evenly spaced: every step-th, where the step is the group's size over ``most``, ``most`` at most."""
    made = numbered(df, group, order, "__at", "__size")
    step = F.greatest(F.lit(1), F.floor(F.col("__size") / most))
    at = F.col("__at") - 1
    return made.where((F.col("__size") <= most) | ((at % step == 0) & (at / step < most))).select(*df.columns)


def unique_or_fail(df: DataFrame, key: Sequence[str], what: str = "key") -> DataFrame:
    """``df`` as it is; a key that repeats fails the query that reads it."""
    many = F.count(F.lit(1)).over(Window.partitionBy(*key)) > 1
    said = F.raise_error(F.concat(F.lit(f"repeated {what}: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in key])))
    return df.withColumn("__ok", F.when(many, said.cast("boolean")).otherwise(F.lit(True))).where("__ok").drop("__ok")


def repeated(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that repeat, with how often."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def is_unique(df: DataFrame, **keys: str) -> DataFrame:
    """One row: for each name whether its column has no value twice."""
    return df.agg(*[(F.count(F.lit(1)) == F.count_distinct(c)).alias(name) for name, c in keys.items()])


def preferred(df: DataFrame, key: Sequence[str], priority: Sequence[str | Column]) -> DataFrame:
    """Of each key's candidates the first by priority."""
    return heads(df, key, priority, 1)


def resolved(wanted: DataFrame, files: DataFrame, path: str, name: str, strict: bool = True) -> DataFrame:
    """``wanted`` with ``resolved``: the file of exactly its ``path``, else the only one that shares its ``name``, else null.

    ``files`` has path and name. Where only the name could tell and several files share it, the query fails (``strict``)
    or gives null.
    """
    exact = files.select(F.col(path).alias("__exact")).distinct()
    by_name = files.groupBy(F.col(name).alias("__name")).agg(F.min(path).alias("__one"), F.count_distinct(path).alias("__n"))
    joined = wanted.join(exact, wanted[path] == exact["__exact"], "left").join(by_name, wanted[name] == by_name["__name"], "left")
    many = F.raise_error(F.concat(F.lit("ambiguous file name: "), wanted[name])) if strict else F.lit(None).cast("string")
    alone = F.when(F.col("__n") > 1, many.cast("string")).otherwise(F.col("__one"))
    return joined.select(*(wanted[c] for c in wanted.columns), F.coalesce("__exact", alone).alias("resolved"))


def slots(df: DataFrame, label: str, out: str = "slot", first: int = 0) -> DataFrame:
    """Distinct labels, sorted, with their numbers. A vocabulary is small: it travels as one array."""
    all_labels = df.agg(F.array_sort(F.collect_set(label)).alias("all"))
    return all_labels.select(F.posexplode("all").alias("__at", label)).select(label, (F.col("__at") + first).alias(out))


def grid(*parts: DataFrame) -> DataFrame:
    """All combinations of configurations; each part is a short list."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(sent(p, "configurations"))
    return out


def status(configs: DataFrame, done: DataFrame, key: str, excluded: Column) -> DataFrame:
    """``configs`` with NOT_EVALUATED where ``excluded``, PENDING where ``done`` lacks the key, else DONE."""
    there = done.select(F.col(key).alias("__key")).distinct()
    joined = configs.join(there, configs[key] == there["__key"], "left")
    return joined.select(*(configs[c] for c in configs.columns), F.when(excluded, "NOT_EVALUATED").when(F.col("__key").isNull(), "PENDING").otherwise("DONE").alias("status"))


def cost_with_accuracy(cost: DataFrame, accuracy: DataFrame, key: str) -> DataFrame:
    """Both tables by model; a model that only one has keeps nulls for the other."""
    return cost.join(accuracy, key, "full")
