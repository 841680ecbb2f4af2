"""Ranks inside keys of which one may hold most of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.llm.common import written

#: Ranges that bounds are sought in at first.
COARSE = 2_048


def range_bounds(df: DataFrame, column: str, n: int) -> list[int]:
    """Numbers that cut a column of whole numbers into about ``n`` ranges of about as many rows each (nulls are before all).

    Rows are dealt to COARSE ranges by Spark; where more are wanted, each of these is cut on executors. The driver gets the
    numbers only."""
    coarse, fine = min(n, COARSE), -(-n // COARSE)
    part = df.select(F.col(column).alias("x")).repartitionByRange(coarse, "x").withColumn("p", F.spark_partition_id()).groupBy("p")
    if fine == 1:
        found = part.agg(F.array(F.min("x")).alias("x"))
    else:
        found = part.agg(F.concat(F.array(F.min("x")), F.percentile_approx("x", [k / fine for k in range(1, fine)], 100 * fine)).alias("x"))
    bounds = sorted({int(x) for r in found.collect() for x in r["x"] or () if x is not None})
    return bounds[1:]


def ranked(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``df`` with idx, a row's number (from 0) among the rows of its ``key`` by ``order``, and n, how many
    these are. ``key`` has no nulls; nulls of ``order`` come first; rows equal in ``order`` come as they may.

    Rows are dealt by ranges of (key, order) and numbered inside each range; a key's counts by range are
    summed up, one row for each range that holds any. So a hot key is spread over as many tasks as its rows need."""
    placed = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, name).withColumn("_range", F.shiftright("_at", 33))
    ranges = placed.groupBy(key, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    based = ranges.select(key, "_range", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_base"), F.sum("_rows").over(Window.partitionBy(key)).alias("n"))
    return placed.join(based, [key, "_range"]).withColumn("idx", F.col("_at") + F.col("_base")).drop("_at", "_range", "_base")
