"""Evaluation of predicted classes and of costs. A class that is absent has no score; null is never zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import at_share, nearest_ranks, percentiles, renamed, same, upper_middle

#: The class that is not counted; what keeps a ratio of zeros finite.
IGNORE, EPS = 255, 1e-9


def valid(truth: Column, classes: int) -> Column:
    """Whether a true class counts: neither ignored nor out of range."""
    return F.coalesce((truth != IGNORE) & truth.between(0, classes - 1), F.lit(False))


def unlabelled(truth: Column, pred: Column) -> Column:
    """The prediction, ignored where the label has no opinion."""
    return F.when(truth == IGNORE, IGNORE).otherwise(pred)


def confusion(df: DataFrame, truth: str, pred: str, group: Sequence[str] = (), overall: bool = False) -> DataFrame:
    """Rows (group, truth, pred, n); with ``overall`` those of all groups together too, under a null group."""
    if not overall:
        return df.groupBy(*group, truth, pred).agg(F.count(F.lit(1)).alias("n"))
    sets = [[*map(F.col, group), F.col(truth), F.col(pred)], [F.col(truth), F.col(pred)]]
    return df.groupingSets(sets, *group, truth, pred).agg(F.count(F.lit(1)).alias("n"))


def class_scores(matrix: DataFrame, truth: str, pred: str, classes: Sequence[int], group: Sequence[str] = ()) -> DataFrame:
    """Rows (group, cls, iou, prec, rec) of a counted confusion matrix, a row per class and group.

    A class that is neither true nor predicted has no IoU, precision or recall. The matrix is small: it is turned over, not the rows behind it.
    """
    t, p, n = F.col(truth), F.col(pred), F.col("n")
    per = F.array(*[F.struct(F.lit(c).alias("cls"), F.when((t == c) & (p == c), n).otherwise(0).alias("tp"), F.when((t != c) & (p == c), n).otherwise(0).alias("fp"), F.when((t == c) & (p != c), n).otherwise(0).alias("fn")) for c in classes])
    sums = matrix.select(*group, F.explode(per).alias("c")).groupBy(*group, "c.cls").agg(*[F.sum(f"c.{x}").cast("double").alias(x) for x in ("tp", "fp", "fn")])
    tp, fp, fn, eps = F.col("tp"), F.col("fp"), F.col("fn"), F.lit(EPS)
    return sums.select(*group, "cls", *[F.when(tp + fp + fn > 0, share).alias(name) for name, share in (("iou", tp / (tp + fp + fn + eps)), ("prec", tp / (tp + fp + eps)), ("rec", tp / (tp + fn + eps)))])


def mean_iou(scores: DataFrame, places: int = 9) -> DataFrame:
    """Mean over the classes that are present."""
    return scores.agg(F.round(F.avg("iou"), places).alias("miou"))


def pixel_accuracy(matrix: DataFrame, truth: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose class is predicted."""
    hit = F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0))
    return matrix.groupBy(*group).agg((hit / F.greatest(F.lit(1), F.sum("n"))).alias("pixel_accuracy"))


def drop_from_largest(df: DataFrame, size: str, score: str, group: Sequence[str] = (), places: int = 1) -> DataFrame:
    """``df`` with the percentage that ``score`` lies below that at the largest ``size``; null where that is missing or not positive."""
    base = F.first(score).over(Window.partitionBy(*group).orderBy(F.col(size).desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    fine = (F.col("__base") > 0) & ~F.isnan("__base") & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    made = df.withColumn("__base", base.cast("double"))
    return made.withColumn("drop_pct", F.when(fine, F.bround(100 * (F.col("__base") - F.col(score)) / F.col("__base"), places))).drop("__base")


def coverage_error(df: DataFrame, truth: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    """Mean and largest absolute error of coverage; rows that lack either are left out."""
    gap = F.abs(F.col(truth) - F.col(pred))
    return df.groupBy(*group).agg(F.avg(gap).alias("mae"), F.max(gap).alias("max_error"), F.count(gap).alias("n"))


def soft_dice(df: DataFrame, group: Sequence[str], score: Column, truth: Column, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """One minus the Tversky index of scores (Dice with halves) for the groups that hold the class."""
    hit, false, missed = F.sum(score * truth), F.sum(score * (1 - truth)), F.sum((1 - score) * truth)
    made = df.groupBy(*group).agg(hit.alias("h"), false.alias("f"), missed.alias("m"), F.sum(truth).alias("y"))
    return made.where("y > 0").select(*group, (1 - F.col("h") / (F.col("h") + alpha * F.col("f") + beta * F.col("m"))).alias("loss"))


def focal(df: DataFrame, group: Sequence[str], score: Column, truth: Column, gamma: float = 2.0) -> DataFrame:
    """Mean focal loss of the probabilities ``score`` of the class where ``truth`` is 1, of the rest where it is 0."""
    p = F.greatest(F.lit(EPS), F.when(truth == 1, score).otherwise(1 - score))
    return df.groupBy(*group).agg(F.avg(-F.pow(1 - p, F.lit(gamma)) * F.log(p)).alias("loss"))


def latency(df: DataFrame, group: Sequence[str], ms: str) -> DataFrame:
    """n, mean, nearest-rank p50 and p90, population deviation and frames a second of latencies."""
    ranks = nearest_ranks(df, group, ms, {"p50": upper_middle, "p90": at_share(0.9)})
    stats = df.groupBy(*group).agg(F.avg(ms).alias("mean"), F.stddev_pop(ms).alias("std"), F.try_divide(F.lit(1000.0), F.avg(ms)).alias("fps"))
    return ranks.join(stats, list(group))


def video_summary(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean, median, least and most of what was measured, and how much was not."""
    v = F.col(value)
    every = df.groupBy(*group).agg(F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.count_if(v.isNull()).alias("unmeasurable"))
    mid = renamed(percentiles(df, group, value, {"med": 0.5}), group)
    return every.join(mid, same(every, mid, group), "left").select(*(every[c] for c in group), "mean", "med", "least", "most", "unmeasurable")


def early_stop(df: DataFrame, key: Sequence[str], order: str, score: str, patience: int) -> DataFrame:
    """Per run: best score, the epoch (1, 2, ...) at which ``patience`` epochs brought no better one, and epochs. NaN is never better."""
    by = Window.partitionBy(*key).orderBy(order)
    value = F.when(~F.isnan(F.col(score).cast("double")), F.col(score))
    seen = df.withColumn("__epoch", F.row_number().over(by)).withColumn("__best", F.max(value).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    better = F.coalesce(F.when(F.col("__best").isNull(), value.isNotNull()).otherwise(value > F.col("__best")), F.lit(False))
    runs = seen.withColumn("__since", F.sum(better.cast("int")).over(by))
    bad = F.row_number().over(Window.partitionBy(*key, "__since").orderBy(order)) - F.when(F.col("__since") > 0, 1).otherwise(0)
    marked = runs.withColumn("__bad", bad)
    return marked.groupBy(*key).agg(F.max(value).alias("best"), F.min(F.when(F.col("__bad") >= patience, F.col("__epoch"))).alias("stop_epoch"), F.count(F.lit(1)).alias("epochs"))


def lag_correlation(series: DataFrame, at: str, cause: str, effect: str, most: int) -> DataFrame:
    """Correlation of ``cause`` with ``effect`` 0 to ``most`` steps later; ``at`` numbers the steps."""
    later = series.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(most)))).select((F.col(at) - F.col("lag")).alias(at), "lag", F.col(effect).alias("__later"))
    return series.select(at, cause).join(later, at).groupBy("lag").agg(F.corr(cause, "__later").alias("r"), F.count(F.lit(1)).alias("n"))


def best_lag(correlations: DataFrame) -> DataFrame:
    """The lag of the highest correlation, of equals the smallest."""
    return correlations.agg(F.max_by("lag", F.struct("r", (-F.col("lag")).alias("early"))).alias("lag"), F.max("r").alias("r"))


def errors(df: DataFrame, difference: Column) -> DataFrame:
    """Root mean square and mean absolute error of whole-number differences; nulls are left out."""
    squared = F.sum((difference * difference).cast("decimal(38,0)")).cast("double")
    return df.agg(F.sqrt(squared / F.count(difference)).alias("rmse"), (F.sum(F.abs(difference)) / F.count(difference)).alias("mae"))


def improvement(ours: Column, baseline: Column) -> Column:
    """By how many percent an error is smaller than the baseline's."""
    return F.when(baseline > 0, 100 * (baseline - ours) / baseline)


def volume(df: DataFrame, key: Sequence[str], order: Sequence[str], area: str, height: str) -> DataFrame:
    """Volume between the first and the last height of each key by trapezoids of the areas."""
    by = Window.partitionBy(*key).orderBy(*order)
    a, h = F.col(area), F.col(height).cast("double")
    step = (a + F.lag(a).over(by)) / 2 * (h - F.lag(h).over(by))
    return df.withColumn("__step", step).groupBy(*key).agg(F.sum("__step").alias("volume"))
