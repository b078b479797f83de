"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: More rounds than any graph needs whose longest path is below 2**60.
MOST_ROUNDS = 120


def _lows(pairs: DataFrame) -> DataFrame:
    """Of each node ``u`` the least of itself and its neighbours; partial minima are made before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (u, v: long) can reach.

    Every round is written to the shared folder. Nothing but a count and a checksum reaches the driver. A node with
    very many neighbours is a skewed key of a join, which adaptive execution splits.
    """
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(MOST_ROUNDS):
        # large star: each node hands its larger neighbours the least node around it
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lows(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # small star: each node joins itself and its smaller neighbours to the least of them
        lows = _lows(large)
        small = large.join(lows, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(lows.select("u", F.col("low").alias("v")))
        now = staged(small.where("u <> v").distinct(), "edges")
        was, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
