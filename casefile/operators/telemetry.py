"""Logs, metrics and telemetry: latency summaries, histograms, health, throughput, state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.operators.ordered import joined, order_statistics, previous

# Upper bounds of latency buckets in seconds.
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def index_percentiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """AGG5: the value at place floor(n q) of the ordered values."""
    at = {k: (lambda n, q=q: F.least(F.floor(n * F.lit(q)), n - 1)) for k, q in quantiles.items()}
    return order_statistics(df, by, value, at).select(*by, *quantiles)


def latency_by_index(df: DataFrame, by: list[str], value: str = "ms", success: str | None = None) -> DataFrame:
    """AGG5: mean, min, max, sample deviation, index percentiles, operations a second, success rate."""
    ok = F.avg(F.col(success).cast("double")) if success else F.lit(1.0)
    base = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), (F.count(F.lit(1)) * 1000 / F.nullif(F.sum(value), F.lit(0.0))).alias("ops_per_s"), ok.alias("success_rate"))
    return joined(base, index_percentiles(df, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}), by, "left")


def interpolated_percentiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """AGG6: between the values at the places around q (n - 1)."""
    ends = {f"_{k}_{e}": (lambda n, q=q, f=f: f(F.lit(q) * (n - 1))) for k, q in quantiles.items() for e, f in (("a", F.floor), ("b", F.ceil))}
    share = lambda q: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
    low, high = (lambda k: F.col(f"_{k}_a")), (lambda k: F.col(f"_{k}_b"))
    return order_statistics(df, by, value, ends).select(*by, *[F.when(low(k) == high(k), low(k)).otherwise(low(k) + (high(k) - low(k)) * share(q)).alias(k) for k, q in quantiles.items()])


def latency_interpolated(df: DataFrame, by: list[str], value: str = "ms") -> DataFrame:
    """AGG6: population deviation, interpolated percentiles, throughput."""
    base = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.count(F.lit(1)) * 1000 / F.nullif(F.sum(value), F.lit(0.0))).alias("throughput"))
    return joined(base, interpolated_percentiles(df, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}), by, "left")


def histogram(df: DataFrame, value: str = "ms", bins: int = 30) -> DataFrame:
    """AGG7: equal bins between minimum and maximum; the maximum lies in the last, as do all values where there is one only.

    The share of the range comes first, then the bin, as in the SQL: another order of these steps rounds values on an edge
    to the other side."""
    edge = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    share = F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")) * bins
    at = F.when(share.isNull() | F.isnan(share), F.lit(bins).cast("long")).otherwise(F.least(F.floor(share) + 1, F.lit(bins).cast("long")))
    return df.crossJoin(F.broadcast(edge)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cumulative_histogram(df: DataFrame, by: list[str], value: str, bounds: list[float] = BUCKETS) -> DataFrame:
    """AGG8: for each bound the number of values up to it, with sum and count; one pass, then a row
    for each bound."""
    sums = df.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"_b{k}") for k, b in enumerate(bounds)], F.sum(value).alias("sum"), F.count(value).alias("count"))
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_b{k}").alias("n")) for k, b in enumerate(bounds)])
    return sums.withColumn("_p", F.explode(pairs)).select(*by, "_p.le", "_p.n", "sum", "count")


def calibration(df: DataFrame, target: float = 0.8, warn: float = 85.0) -> DataFrame:
    """AGG14 over telemetry(device, gpu_temp_c, power_draw_w, throttled)."""
    x = df.groupBy("device").agg(F.avg("gpu_temp_c").alias("avg"), F.max("gpu_temp_c").alias("max"), F.min("gpu_temp_c").alias("min"), F.stddev_pop("gpu_temp_c").alias("std"), F.avg("power_draw_w").alias("w"), F.count_if("throttled").alias("throttle_events"))
    room = warn - F.col("max")
    load = F.when(room < 0, F.greatest(F.lit(0.5), F.lit(target - 0.15))).when(room < 5, F.greatest(F.lit(0.6), F.lit(target - 0.10))).when(room < 10, F.lit(target)).otherwise(F.least(F.lit(0.95), F.lit(target + 0.05)))
    return x.select("device", F.round("avg", 1).alias("avg_temp"), F.round("max", 1).alias("max_temp"), F.round("min", 1).alias("min_temp"), F.round("std", 2).alias("temp_stability"), F.round("w", 1).alias("avg_power"), "throttle_events", F.round(load, 2).alias("recommended_load"), F.round(room, 1).alias("thermal_headroom"))


def last_n(df: DataFrame, by: list[str], n: int, ts: str = "ts", key: str = "id") -> DataFrame:
    """WIN6: the last n rows of each series."""
    w = Window.partitionBy(*by).orderBy(F.desc(ts), F.desc(key))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def query_health(log: DataFrame, by: list[str], slow_ms: float = 100.0, last: int = 100) -> DataFrame:
    """AGG15 over a log (ms, success, ts, id): totals, error rate, mean and 95th percentile of the
    successful among the last queries, and the status."""
    total = log.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("success")).alias("errors"), F.count_if(F.col("ms") > slow_ms).alias("slow"))
    recent = last_n(log, by, last).filter("success").groupBy(*by).agg(F.sort_array(F.collect_list("ms")).alias("v"), F.avg("ms").alias("mean"))
    p95 = F.when(F.size("v") > 20, F.get("v", F.floor(F.size("v") * 0.95).cast("int"))).otherwise(F.col("mean"))
    out = total.join(recent.select(*by, "mean", p95.alias("p95")), by, "left").withColumns({"mean": F.coalesce("mean", F.lit(0.0)), "p95": F.coalesce("p95", F.lit(0.0))})
    rate = F.round(F.col("errors") / F.greatest("total", F.lit(1)) * 100, 2)
    return out.withColumn("error_rate", rate).withColumn("status", F.when(F.col("error_rate") > 5, "degraded").when(F.col("p95") > 500, "warning").otherwise("healthy"))


def latest_where(log: DataFrame, condition: Column, n: int = 10, ts: str = "ts", key: str = "id") -> DataFrame:
    """SRT3: the last slow queries or errors."""
    return log.filter(condition).orderBy(F.desc(ts), F.desc(key)).limit(n)


def throughput(df: DataFrame, ts: str = "ts", width: str = "1 second") -> DataFrame:
    """AGG19: items by interval, and their mean over the intervals that have any."""
    n = df.groupBy(F.window(ts, width)["start"].alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.avg("n").alias("mean_n"))))


def analysis_counters(log: DataFrame) -> DataFrame:
    """AGG20."""
    return log.groupBy("agent", "status").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_ms"))


def state_changes(df: DataFrame, by: list[str], state: str, ts: str = "ts", key: str = "id") -> DataFrame:
    """WIN10: rows whose state differs from the one before."""
    before = F.col("_before")[state]
    return previous(df, by, [ts, key], [state]).withColumn("previous", before).drop("_idx", "_before").filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(state)))


def sliding_limit(requests: DataFrame, by: str, seconds: int = 60, limit: int = 100, ts: str = "ts") -> DataFrame:
    """WIN11: for each request those of its key in the window before it, rejected ones included;
    whether it is allowed; what remains.

    A key's requests are dealt out by stretches of time as long as the window; each stretch also gets the counts of the one before, by
    the microsecond, so that a hot key is a task for each stretch."""
    span = seconds * 1_000_000
    timed = requests.withColumn("_micros", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_stretch", F.floor(F.col("_micros") / span))
    counts = timed.groupBy(by, "_stretch", "_micros").agg(F.count(F.lit(1)).alias("_c")).withColumn("_own", F.lit(True))
    halo = counts.withColumns({"_stretch": F.col("_stretch") + 1, "_own": F.lit(False)})
    w = Window.partitionBy(by, "_stretch").orderBy("_micros").rangeBetween(-span + 1, -1)
    seen = counts.unionByName(halo).withColumn("seen", F.coalesce(F.sum("_c").over(w), F.lit(0).cast("long"))).filter("_own").drop("_own", "_c")
    out = joined(timed, seen, [by, "_stretch", "_micros"]).drop("_stretch", "_micros")
    return out.withColumns({"allowed": F.col("seen") < limit, "remaining": F.greatest(F.lit(0).cast("long"), limit - F.col("seen") - 1)})


def against_baseline(current: DataFrame, baseline: DataFrame, lower_is_better: list[str]) -> DataFrame:
    """JOIN6: metrics (metric, value) against a baseline: change in percent, and whether it is an
    improvement in the metric's own direction."""
    both = current.join(baseline.withColumnRenamed("value", "base"), "metric").filter("base > 0")
    change = F.round((F.col("value") - F.col("base")) / F.col("base") * 100, 2)
    lower = F.col("metric").isin(lower_is_better)
    return both.withColumn("change_pct", change).withColumn("improved", F.when(lower, F.col("value") < F.col("base")).otherwise(F.col("value") > F.col("base")))
