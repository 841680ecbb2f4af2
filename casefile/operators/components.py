"""Connected components by contraction: every node goes to its smallest neighbour, chains are shortened, and
links are carried over to what is left, until none is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.session import shared_dir

ROUNDS = 100


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of the links (a, b), of any ordered type.

    Minima are partial sums, joins are by node and split where a node is hot. A node that is smaller than all of its neighbours
    has one whose smallest neighbour is smaller still, unless it takes that one in, so nodes with links at least halve in two rounds."""
    now = kept(links.filter("a <> b").select("a", "b").distinct())
    place = kept(now.select(F.col("a").alias("node")).union(now.select("b")).distinct().withColumn("component", F.col("node")))
    for _ in range(ROUNDS):
        both = now.union(now.select("b", "a"))
        up = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("y")))
        while up.filter("x <> y").limit(1).count():
            over = up.select(F.col("x").alias("y"), F.col("y").alias("z"))
            further = kept(up.join(over, "y").select("x", F.col("z").alias("y")))
            same = further.join(up, ["x", "y"], "left_anti").limit(1).count() == 0
            up = further
            if same:
                break
        place = kept(place.join(up, F.col("component") == F.col("x"), "left").select("node", F.coalesce("y", "component").alias("component")))
        a, b = up.select(F.col("x").alias("a"), F.col("y").alias("to_a")), up.select(F.col("x").alias("b"), F.col("y").alias("to_b"))
        now = kept(now.join(a, "a").join(b, "b").filter("to_a <> to_b").select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct())
        if not now.limit(1).count():
            return place
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
