"""Rows before and values at ranks, for keys and groups of which one may hold most of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.operators.components import kept

#: Values that one task sorts; slices of a range of values that is too large for that.
FEW, SLICES = 4_096, 4_096


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which nulls are equal; the right side's keys are left out."""
    other = right.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        on = same if on is None else on & same
    return left.join(other, on, how).drop(*[f"_of_{k}" for k in keys])


def previous(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``df`` with _idx, a row's place (from 0) in the order of its key, and _before, a struct of the ``values`` of the row before.

    Rows are dealt by ranges of (by, order). Each range is looked through apart; what the first of a range needs of the
    one before comes from a row for each range. So a hot key is as many tasks as its rows need."""
    placed = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = kept(placed).withColumn("_range", F.shiftright("_at", 33))
    row = F.struct(*values)
    ranges = placed.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"), F.max_by(row, "_at").alias("_last"))
    over = Window.partitionBy(*by).orderBy("_range")
    so_far = F.coalesce(F.sum("_rows").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = ranges.select(*by, "_range", "_first", (so_far - F.col("_first")).alias("_base"), F.lag("_last").over(over).alias("_carried"))
    near = placed.withColumn("_near", F.lag(row).over(Window.partitionBy(*by, "_range").orderBy("_at")))
    both = joined(near, carried, [*by, "_range"])
    before = F.when(F.col("_at") == F.col("_first"), F.col("_carried")).otherwise(F.col("_near"))
    return both.select(*[f"`{c}`" for c in df.columns], (F.col("_at") + F.col("_base")).alias("_idx"), before.alias("_before"))


def _octave(v: Column) -> Column:
    """A number that does not fall where a double rises, 64 to each power of two."""
    size = (F.floor(F.log2(F.abs(v)) * 64) + 70_000).cast("long")
    far = F.when(F.isnan(v), F.lit(300_000)).when(F.abs(v) == float("inf"), F.signum(v).cast("long") * 200_000)
    return F.when(v == 0, F.lit(0).cast("long")).when(far.isNotNull(), far.cast("long")).otherwise(F.signum(v).cast("long") * size)


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``by``, n (values that are not null) and, for each name, the value (a double) at the rank from 0 that ``ranks`` makes of n.

    Values are counted by ranges of doubles; the range that holds a rank is counted again by finer slices, until it holds few values
    or one only. No group's values meet in one task, each pass reads what the one before has left, and results are exact."""
    key = [*by, "_bin"]
    rows = kept(df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")).withColumn("_bin", _octave(F.col("_v")).cast("string")))
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    wanted = whole.select(*by, "n", F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), rank(F.col("n")).cast("long").alias("_rank")) for name, rank in ranks.items()])).alias("_w")).select(*by, "_w.*")
    counts = rows.groupBy(*by, "_bin", _octave(F.col("_v")).alias("_slice")).agg(F.count(F.lit(1)).alias("_c"))
    targets = kept(_held(counts, wanted, by))
    found = None
    while True:
        rows = kept(joined(rows, targets.select(*key).distinct(), key))
        edges = rows.groupBy(*key).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_n"))
        targets = kept(joined(targets, edges, key))
        one = targets.filter("_low = _high").select(*by, "_name", F.col("_low").alias("_v"))
        small = targets.filter(f"_low < _high and _n <= {FEW}")
        sorted_ = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("_v")) - 1)
        near = joined(joined(sorted_, edges.filter(f"_n <= {FEW}").select(*key, "_n"), key).withColumnRenamed("_k", "_rank").drop("_n"), small.select(*key, "_rank", "_name"), [*key, "_rank"])
        done = one.unionByName(near.select(*by, "_name", "_v"))
        found = done if found is None else found.unionByName(done)
        large = targets.filter(f"_low < _high and _n > {FEW}")
        if not large.limit(1).count():
            break
        part = joined(rows, large.select(*key, "_low", "_high").distinct(), key)
        sliced = part.withColumn("_slice", F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * SLICES), F.lit(SLICES - 1)).cast("long"))
        counts = sliced.groupBy(*key, "_slice").agg(F.count(F.lit(1)).alias("_c"))
        targets = kept(_held(counts, large.select(*key, "_name", "_rank"), key).withColumn("_bin", F.concat_ws(".", "_bin", "_slice")).drop("_slice"))
        rows = sliced.select(*by, F.concat_ws(".", "_bin", "_slice").alias("_bin"), "_v")
    values = found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])
    return joined(whole, values, by)


def _held(counts: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """For each wanted rank the slice that holds it, and its rank in there."""
    w = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    from_ = counts.withColumn("_from", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    own = wanted.drop("_bin") if "_bin" not in by else wanted
    held = joined(from_, own, by).filter("_rank >= _from and _rank < _from + _c").withColumn("_rank", F.col("_rank") - F.col("_from"))
    return held.drop("_from", "_c") if "_bin" in by else held.drop("_from", "_c", "_slice")
