"""Connected components over links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.llm.common import cut

ROUNDS = 60


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours (larger ones only, or the smaller ones and itself) are linked to the
    smallest of node and neighbours. Minima are partial sums; the join back splits a hot node."""
    if larger:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(least, "u")
    if larger:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of the links (a, b), of any
    ordered type. Nodes without links do not occur. Rounds repeat until the links no longer change,
    about log^2 of the longest path; each is checkpointed in the shared folder."""
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    for _ in range(ROUNDS):
        now = cut(_star(_star(now, True), False))
        sum_ = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sum_ == seen:
            break
        seen = sum_
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
