"""Checks of data sets, review lists and sources. Findings are rows; what must not be is an error of the query that reads it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import sent
from .order import placed

#: Shares of pixels below which debris is missing, and water suspicious.
DEBRIS_FLOOR, WATER_FLOOR = 1e-5, 1e-4
VERDICTS = ("ok", "reject", "")


def mapped_labels(df: DataFrame, table: DataFrame, key: str, slot: str, policy: str = "error", background: int = 0, ignore: int = 255) -> DataFrame:
    """``df`` with ``mapped``, the ``slot`` of its label; an unmapped label fails the query, or is background or ignored."""
    if policy not in ("error", "background", "ignore"):
        raise ValueError(f"unknown policy {policy!r}")
    right = table.select(F.col(key).alias("__key"), F.col(slot).alias("__slot"))
    joined = df.join(right, df[key] == right["__key"], "left")
    other = F.raise_error(F.concat(F.lit("unmapped label: "), F.coalesce(df[key].cast("string"), F.lit("null")))).cast("int") if policy == "error" else F.lit(background if policy == "background" else ignore)
    return joined.select(*(df[c] for c in df.columns), F.when(F.col("__key").isNull(), other).otherwise(F.col("__slot")).alias("mapped"))


def orphans(df: DataFrame, value: str, classes: DataFrame, key: str) -> DataFrame:
    """Values that no class has, with how often; null is no class."""
    known = sent(classes.select(F.col(key).alias("__known")).distinct(), "classes")
    return df.join(known, df[value] == known["__known"], "left_anti").groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def class_shares(df: DataFrame, classes: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Rows or weights per class and their share of all, of one at least."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(*classes).agg(n.alias("n"))
    total = counts.agg(F.greatest(F.lit(1), F.sum("n")).cast("double").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).select(*classes, "n", (F.col("n") / F.col("__total")).alias("share"))  # one row


def share_findings(shares: DataFrame, dataset: str, debris: str = "debris", water: str = "water", water_source: str = "water_source") -> DataFrame:
    """(scope, level, message): debris that is as good as absent is an error, water that is, where some is meant to be, a warning."""
    low = F.array(
        F.when(F.coalesce(F.col(debris), F.lit(0.0)) < DEBRIS_FLOOR, F.struct(F.lit("error").alias("level"), F.concat(F.lit("debris is "), F.format_string("%.2e", F.coalesce(F.col(debris), F.lit(0.0))), F.lit(" of pixels")).alias("message"))),
        F.when((F.coalesce(F.col(water), F.lit(0.0)) < WATER_FLOOR) & ~(F.coalesce(F.col(water_source), F.lit("?")) == "none"), F.struct(F.lit("warning").alias("level"), F.concat(F.lit("water is "), F.format_string("%.2e", F.coalesce(F.col(water), F.lit(0.0))), F.lit(" of pixels")).alias("message"))),
    )
    return shares.select(F.col(dataset).alias("scope"), F.explode(F.filter(low, lambda x: x.isNotNull())).alias("f")).select("scope", "f.*")


def missing_files(meta: DataFrame, listing: DataFrame, id_col: str, columns: Sequence[str], path: str = "path") -> DataFrame:
    """(scope, level, message) for every file that ``meta`` names in ``columns`` and ``listing`` lacks."""
    named = meta.select(F.col(id_col).cast("string").alias("scope"), F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("file")) for c in columns])).alias("f")).select("scope", "f.*")
    there = listing.select(F.col(path).alias("__path")).distinct()
    gone = named.join(there, named["file"] == there["__path"], "left_anti")
    return gone.select("scope", F.lit("error").alias("level"), F.concat("kind", F.lit(" missing"), F.coalesce(F.concat(F.lit(" ("), F.col("file"), F.lit(")")), F.lit(""))).alias("message"))


def label_warnings(datasets: DataFrame, dataset: str = "dataset", water_source: str = "water_source", labelled: str = "has_pseudolabels", reviewed: str = "has_exclusions") -> DataFrame:
    """(scope, level, message) for data sets whose water is still to be labelled, or is labelled and not reviewed."""
    pending = F.col(water_source) == "pseudo_pending"
    said = F.when(pending & ~F.coalesce(F.col(labelled), F.lit(False)), "water labels are pending and have not been made").when(pending & ~F.coalesce(F.col(reviewed), F.lit(False)), "water labels have not been reviewed: unreviewed water is in the training data")
    return datasets.select(F.col(dataset).alias("scope"), F.lit("warning").alias("level"), said.alias("message")).where("message IS NOT NULL")


def failures(df: DataFrame, error: str) -> DataFrame:
    """Failures by the class of their error, which is what stands before the first colon; rows without one did not fail."""
    kind = F.trim(F.split(error, ":", 2)[0])
    return df.where(F.col(error).isNotNull()).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def totals(findings: DataFrame) -> DataFrame:
    """One row: errors and warnings."""
    level = F.col("level")
    return findings.agg(F.count_if(level == "error").alias("errors"), F.count_if(level == "warning").alias("warnings"))


def verdict(value: Column) -> Column:
    """A review verdict, lower case; blank is not reviewed, anything but ok and reject fails the query that reads it."""
    said = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(said.isin(*VERDICTS), said).otherwise(F.raise_error(F.concat(F.lit("no verdict: "), said)).cast("string"))


def excluded(reviews: DataFrame, value: str) -> DataFrame:
    """Reviewed rows that must not be used: rejected, or flagged and never reviewed."""
    return reviews.withColumn("verdict", verdict(F.col(value))).where("verdict <> 'ok'")


def flag(area: Column, score: Column, seeded: Column, smallest: float, largest: float, least: float) -> Column:
    """The first of too_small, too_large, low_score and no_debris_seed that holds, else empty."""
    return F.when(area < smallest, "too_small").when(area > largest, "too_large").when(score < least, "low_score").when(~seeded, "no_debris_seed").otherwise("")


def counts(df: DataFrame, value: Column, name: str) -> DataFrame:
    """How often each value stands."""
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def top(df: DataFrame, value: str, n: int) -> DataFrame:
    """The ``n`` values that stand most often, of equals the smaller first."""
    return counts(df, F.col(value), value).orderBy(F.desc("n"), value).limit(n)


def worst_first(df: DataFrame, flagged: Column, score: str, key: str) -> DataFrame:
    """``df`` with its place in the order of review: flagged rows first, then by ascending score, then by key, of whatever type."""
    keyed = df.withColumn("__clean", F.when(flagged, 0).otherwise(1))
    return placed(keyed, ["__clean", score, key]).drop("__clean")


def ranges(df: DataFrame, key: Sequence[str], value: str, missing: Column) -> DataFrame:
    """Least, most, rows and missing rows of each key."""
    return df.groupBy(*key).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("missing"))


def totals_by_kind(df: DataFrame, keys: Sequence[str], amount: Column) -> DataFrame:
    """Totals by source and kind, never across kinds."""
    return df.groupBy(*keys).agg(F.sum(amount).alias("total"))


def polling_gaps(df: DataFrame, key: str, order: str, at: Column) -> DataFrame:
    """Steps back in time and the longest gap between rows of each key, in the unit of ``at``."""
    gap = at - F.lag(at).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("__gap", gap).groupBy(key).agg(F.count_if(F.col("__gap") < 0).alias("backward"), F.max("__gap").alias("longest"))


def echo_state(df: DataFrame, key: str, value: str, blind: float, base: float, slack: float) -> DataFrame:
    """(state, height) of each key's echoes: timeout without any, too_close below ``blind``, out_of_range beyond ``base`` + ``slack``.

    The distance is the upper middle of the echoes; the height is what is left of ``base``, never negative, and null
    unless the state is ok.
    """
    from .ranks import nearest_ranks, renamed, same, upper_middle

    mids = renamed(nearest_ranks(df, [key], value, {"d": upper_middle}), [key])
    every = df.select(key).distinct()
    made = every.join(mids, same(every, mids, [key]), "left")
    d = F.col("d")
    state = F.when(d.isNull(), "timeout").when(d < blind, "too_close").when(d > base + slack, "out_of_range").otherwise("ok")
    return made.select(key, state.alias("state"), F.when(state == "ok", F.greatest(F.lit(0.0), base - d)).alias("height"))


def one_of(*columns: Column) -> Column:
    """Whether exactly one of ``columns`` is given."""
    return sum((c.isNotNull().cast("int") for c in columns), F.lit(0)) == 1
