"""Text reports of small result tables: aligned with Markdown, written as one file by Spark.

Null is shown as ``-``, a number that is none as ``n/a``; other numbers have the decimals that their column names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A report is for people: a table with more rows is refused, not cut.
MOST_ROWS = 10_000


def shown(df: DataFrame, name: str, decimals: int | None = None) -> Column:
    """A column as the text of its cell."""
    kind, col = dict(df.dtypes)[name], F.col(f"`{name}`")
    text = col.cast("string")
    if decimals is not None:
        text = F.format_string(f"%.{decimals}f", col.cast("double"))
    if kind in ("double", "float"):
        text = F.when(F.isnan(col), "n/a").otherwise(text)
    return F.when(col.isNull(), "-").otherwise(F.replace(text, F.lit("|"), F.lit("\\|")))


def table_rows(df: DataFrame, decimals: dict[str, int] | None = None) -> DataFrame:
    """A line of Markdown per row of ``df``, after the columns of ``df``."""
    cells = [shown(df, name, (decimals or {}).get(name)) for name in df.columns]
    return df.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))


def table_lines(df: DataFrame, order: Iterable[str], decimals: dict[str, int] | None = None) -> list[str]:
    """A Markdown table of a small ``df`` in the given order."""
    lines = [r["line"] for r in table_rows(df, decimals).orderBy(*order).select("line").limit(MOST_ROWS + 1).collect()]
    if len(lines) > MOST_ROWS:
        raise ValueError(f"a report takes at most {MOST_ROWS} rows")
    return [f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns), *lines]


def section(title: str, df: DataFrame, order: Iterable[str], decimals: int | None = None) -> list[str]:
    """A heading and a table; ``decimals`` is for fractions."""
    places = {} if decimals is None else {name: decimals for name, kind in df.dtypes if kind in ("double", "float")}
    return ["", f"### {title}", "", *table_lines(df, order, places)]


def validation_report(datasets: DataFrame, splits: DataFrame, findings: DataFrame) -> list[str]:
    """Lines of the report on checked data: what was found, a row each, the worst first, then datasets and splits.

    ``findings`` has scope, level (``error`` or ``warning``) and message.
    """
    found = findings.select("level", "scope", "message")
    n = {r["level"]: r["n"] for r in found.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    lines = ["## Checked data", "", f"errors: {n.get('error', 0)}, warnings: {n.get('warning', 0)}"]
    lines += section("Findings", found, ["level", "scope", "message"]) if n else []
    return [*lines, *section("Datasets", datasets, datasets.columns[:1], 4), *section("Splits", splits, splits.columns[:1])]


def comparison_report(cost: DataFrame, accuracy: DataFrame | None = None, notes: Iterable[str] = ()) -> list[str]:
    """Lines of the model comparison: cost by model, accuracy by model and resolution (None: not measured yet), notes as they are."""
    scored = ["", "### Accuracy", "", "not measured yet"] if accuracy is None else section("Accuracy", accuracy, accuracy.columns[:2], 4)
    return ["## Models", *section("Cost", cost, cost.columns[:1], 1), *scored, "", *notes]


def write_report(spark: SparkSession, lines: list[str], path: str) -> None:
    """One text file in a new folder; a folder that is there is left alone and the call fails."""
    rows = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    rows.coalesce(1).sortWithinPartitions("n").select("value").write.mode("errorifexists").text(path)
