"""Reads and changes of the relational tables: filters, joins, counts, pages, updates.

Tables are partitioned by case or date; nothing here collects rows. Aggregates come before joins, so
that a join never multiplies rows.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The statuses, in their order.
EVIDENCE_STATUSES = ["pending", "processing", "analyzed", "verified", "flagged", "error"]
JOB_STATUSES = ["queued", "running", "completed", "failed"]
CASE_STATUSES = ["open", "active", "pending_review", "closed", "archived"]


def matching(df: DataFrame, **values: Any) -> DataFrame:
    """FIL1, FIL3: equal to every value that is given; None filters nothing."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == F.lit(kv[1])), [kv for kv in values.items() if kv[1] is not None], df)


def search_cases(cases: DataFrame, words: str | None) -> DataFrame:
    """FIL2: title or number contain the words, whatever their case."""
    if not words:
        return cases
    has = lambda c: F.contains(F.lower(c), F.lit(words.lower()))
    return cases.filter(has("title") | has("case_number"))


def pending(evidence: DataFrame, limit: int | None = None) -> DataFrame:
    """FIL3, SRT2: what waits, oldest first."""
    out = evidence.filter(F.col("status") == "pending").orderBy("created_at", "evidence_id")
    return out if limit is None else out.limit(limit)


def readable(evidence: DataFrame) -> DataFrame:
    """FIL4: results may be read."""
    return evidence.filter(F.col("status").isin("analyzed", "verified"))


def behavioral_minimum(text: Column) -> Column:
    """FIL5: there is enough to score."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) >= 10


def case_counts(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """JOIN1, JOIN2: each case with its number of evidence, 0 included."""
    n = evidence.groupBy("case_id").agg(F.count("evidence_id").alias("evidence_count"))
    return cases.join(n, "case_id", "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))


def full_evidence(evidence: DataFrame, cases: DataFrame, custody: DataFrame, results: DataFrame) -> DataFrame:
    """JOIN3: evidence with its case, custody entries and results as ordered arrays."""
    chain = custody.groupBy("evidence_id").agg(F.sort_array(F.collect_list(F.struct("ts", "id", "action", "input_hash", "output_hash"))).alias("custody"))
    found = results.groupBy("evidence_id").agg(F.sort_array(F.collect_list(F.struct("seq", "agent_type", "confidence"))).alias("results"))
    return evidence.join(cases, "case_id", "left").join(chain, "evidence_id", "left").join(found, "evidence_id", "left")


def shared_content(items: DataFrame, key: str = "sha256") -> DataFrame:
    """JOIN7: hashes that occur under several items."""
    return items.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("item_id").alias("items"), F.min("item_id").alias("first_item")).filter("items > 1")


def reusable(texts: DataFrame, results: DataFrame, now: Column, ttl_seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """JOIN8: texts whose result (text_hash, made_at) is younger than the TTL, with it; and the rest."""
    keyed = texts.withColumn("text_hash", F.substring(F.sha2("text", 256), 1, 32))
    fresh = results.filter(F.col("made_at") > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    latest = fresh.groupBy("text_hash").agg(F.max_by("result", "made_at").alias("result"))
    return keyed.join(latest, "text_hash"), keyed.join(latest, "text_hash", "left_anti")


def with_embeddings(evidence: DataFrame, embeddings: DataFrame, confidence: str = "confidence") -> DataFrame:
    """JOIN9: embeddings joined in; their presence adds 0.1 to the confidence."""
    both = evidence.join(embeddings.select("evidence_id", "embedding"), "evidence_id", "left")
    return both.withColumn(confidence, F.when(F.col("embedding").isNotNull(), F.least(F.lit(1.0), F.col(confidence) + 0.1)).otherwise(F.col(confidence)))


def status_counts(df: DataFrame, statuses: list[str] = EVIDENCE_STATUSES) -> DataFrame:
    """AGG1: every status with its count, and the total."""
    names = df.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    n = df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return F.broadcast(names).join(n, "status", "left").crossJoin(F.broadcast(total)).select("status", F.coalesce("n", F.lit(0)).alias("n"), "total")


def case_summary(evidence: DataFrame) -> DataFrame:
    """AGG2."""
    return evidence.groupBy("case_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin("analyzed", "verified")).alias("analyzed"), F.count_if(F.col("status") == "flagged").alias("flagged"))


def pipeline_metrics(runs: DataFrame) -> DataFrame:
    """AGG4: by evidence type and in all (type null): processed, ok, failed, mean time, success rate."""
    return runs.rollup("evidence_type").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.avg("time_ms").alias("mean_ms"), (F.count_if("success") / F.count(F.lit(1))).alias("success_rate"),
    )


def batch_summary(jobs: DataFrame) -> DataFrame:
    """AGG16."""
    return jobs.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"))


def page(df: DataFrame, number: int, size: int, newest: str = "created_at", key: str = "evidence_id") -> DataFrame:
    """SRT1: a page, newest first, with the total and the number of pages. For deep pages use
    ``page_after``, which skips nothing."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(F.desc(newest), key).offset((number - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size))


def page_after(df: DataFrame, last: tuple[Any, Any] | None, size: int, newest: str = "created_at", key: str = "evidence_id") -> DataFrame:
    """SRT1: the rows that follow the last row seen (its time and key)."""
    if last is not None:
        df = df.filter((F.col(newest) < F.lit(last[0])) | ((F.col(newest) == F.lit(last[0])) & (F.col(key) > F.lit(last[1]))))
    return df.orderBy(F.desc(newest), key).limit(size)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """WIN5, WIN6, WIN7: the first k rows of each group. Spark keeps only k a task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def new_content(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """SRC12: what is neither stored in its case yet nor repeated among the incoming (first by
    evidence_id stays)."""
    fresh = incoming.join(stored.select("case_id", "original_hash").distinct(), ["case_id", "original_hash"], "left_anti")
    return top_per_group(fresh, ["case_id", "original_hash"], [F.col("evidence_id")], 1).drop("rank")


def with_status(df: DataFrame, updates: DataFrame) -> DataFrame:
    """SET2: statuses of (evidence_id, new_status) taken over."""
    return df.join(updates, "evidence_id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def retained(jobs: DataFrame, cutoff: Column) -> DataFrame:
    """SET3: without jobs completed before the cutoff."""
    return jobs.filter(~F.coalesce((F.col("status") == "completed") & (F.col("completed_at") < cutoff), F.lit(False)))


def closed(cases: DataFrame, ids: DataFrame, now: Column, status: str = "closed") -> DataFrame:
    """SET4: cases closed (with the time) or archived (soft delete)."""
    hit = cases.join(ids.select("case_id", F.lit(True).alias("_hit")), "case_id", "left")
    at = F.when(F.col("_hit") & F.lit(status == "closed"), now).otherwise(F.col("closed_at"))
    return hit.withColumns({"status": F.when(F.col("_hit"), status).otherwise(F.col("status")), "closed_at": at}).drop("_hit")


def versioned_update(df: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SET5: updates (evidence_id, version, new_status) are taken where the version still holds;
    returns the new table and the conflicts."""
    u = updates.select("evidence_id", F.col("version").alias("_seen"), "new_status")
    both = df.join(u, "evidence_id", "left")
    hit = F.coalesce(F.col("_seen") == F.col("version"), F.lit(False))
    new = both.withColumns({"status": F.when(hit, F.col("new_status")).otherwise(F.col("status")), "version": F.col("version") + hit.cast("int")}).drop("_seen", "new_status")
    return new, updates.join(df.select("evidence_id", "version"), ["evidence_id", "version"], "left_anti")
