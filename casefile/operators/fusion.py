"""Fusion of results, anomalies and the output gate.

``evidence`` has one row for each item, ``results`` one for each analyser's result: evidence_id, seq,
agent_type, confidence and errors (array). Results are grouped by evidence once; groups are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.functions import score as s
from casefile.functions.lexicon import Fusion


def ok() -> Column:
    """A result without errors."""
    return F.coalesce(F.size("errors"), F.lit(0)) <= 0


def result_summary(results: DataFrame) -> DataFrame:
    """evidence_id, mean_confidence of successful results (null if none) and kinds."""
    return results.groupBy("evidence_id").agg(F.avg(F.when(ok(), F.col("confidence"))).alias("mean_confidence"), F.count_distinct("agent_type").alias("kinds"))


def weighted_fusion(results: DataFrame) -> DataFrame:
    """SCR11: mean of confidences, each weighed by itself; a plain mean where all are zero."""
    c = F.when(ok(), F.col("confidence"))
    out = results.groupBy("evidence_id").agg(F.sum(c * c).alias("cc"), F.sum(c).alias("c"), F.avg(c).alias("mean"))
    score = F.when(F.col("c") > 0, F.try_divide("cc", "c")).otherwise(F.coalesce("mean", F.lit(0.0)))
    return out.select("evidence_id", score.alias("score"), F.when(F.col("c").isNull(), "no_data").otherwise(s.banded(score, s.BANDS)).alias("classification"))


def attention_fusion(results: DataFrame) -> DataFrame:
    """SCR11: mean confidence of each kind, weighed by the softmax of these means (shifted by their
    maximum)."""
    by_kind = results.filter(ok()).groupBy("evidence_id", "agent_type").agg(F.avg("confidence").alias("m"))
    top = F.max("m").over(Window.partitionBy("evidence_id"))
    weighed = by_kind.withColumn("w", F.exp(F.col("m") - top)).groupBy("evidence_id").agg((F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias("score"))
    every = results.select("evidence_id").distinct().join(weighed, "evidence_id", "left")
    return every.select("evidence_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("score").isNull(), "no_data").otherwise(s.banded(F.col("score"), s.BANDS)).alias("classification"))


def consistency(results: DataFrame, apart: float = Fusion.outlier) -> DataFrame:
    """SCR14: agreement of the kinds' mean confidences, and the kinds far from the mean."""
    by_kind = results.groupBy("evidence_id", "agent_type").agg(F.avg(F.when(ok(), F.col("confidence"))).alias("m"))
    w = Window.partitionBy("evidence_id")
    marked = by_kind.withColumn("off", F.abs(F.col("m") - F.avg("m").over(w)) > apart)
    out = marked.groupBy("evidence_id").agg(F.var_pop("m").alias("v"), F.count("m").alias("n"), F.sort_array(F.collect_list(F.when(F.col("off"), F.col("agent_type")))).alias("outliers"))
    score = F.when(F.col("n") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("v") * 4))
    return out.select("evidence_id", score.alias("consistency"), F.when(F.col("n") < 2, F.array().cast("array<string>")).otherwise(F.col("outliers")).alias("outliers"))


def anomalies(results: DataFrame, low: float = Fusion.low_confidence) -> DataFrame:
    """SCR15: one row for each failed or doubtful result."""
    kind = F.when(~ok(), "processing_error").when(F.col("confidence") < low, "low_confidence")
    return results.withColumn("type", kind).filter("type is not null").select("evidence_id", "seq", "agent_type", "type", F.to_json(F.struct("type", F.col("agent_type").alias("agent"), "confidence", "errors")).alias("detail"))


def fusion_confidence(score: Column, agreement: Column, kinds: Column) -> Column:
    """SCR16."""
    return s.one(0.5 + F.abs(score - 0.5) + agreement * 0.2 + F.least(F.lit(0.1), kinds * 0.03))


def reason(code: str, severity: str, detail: Column | str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def block_reasons(evidence: DataFrame, results: DataFrame, fusion: Fusion = Fusion()) -> DataFrame:
    """SCR17: evidence_id, ord, code, severity and detail, a row for each reason.

    ``evidence`` has evidence_id, deception, manipulation, fused_score, text (all may be null) and
    timeline_valid.
    """
    f2 = lambda text, c: F.format_string(text + " %.2f", c)
    own = [
        F.when(F.col("deception") > fusion.deception, reason("HIGH_DECEPTION_SCORE", "high", f2("Deception indicators at", F.col("deception")))),
        F.when(F.col("manipulation") > fusion.manipulation, reason("HIGH_MANIPULATION_SCORE", "medium", f2("Manipulation score at", F.col("manipulation")))),
        F.when(F.col("fused_score") < fusion.least_score, reason("LOW_FUSION_SCORE", "high", f2("Fused confidence score only", F.col("fused_score")))),
        F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) < fusion.least_chars, reason("MISSING_CONTENT", "high", "Insufficient extracted text content")),
        F.when(~F.col("timeline_valid"), reason("IMPOSSIBLE_TIMELINE", "critical", "Treatment dates precede incident date")),
    ]
    first = evidence.select("evidence_id", F.posexplode(F.array(*own)).alias("ord", "r")).filter("r is not null")
    from_results = [
        F.when(~ok(), reason("ANALYSIS_ERROR", "high", F.concat_ws(": ", "agent_type", F.get("errors", F.lit(0))))),
        F.when(F.col("confidence") < fusion.least_confidence, reason("LOW_AGENT_CONFIDENCE", "medium", f2("confidence only", F.col("confidence")))),
        F.when(~ok() | (F.col("confidence") < fusion.low_confidence), reason("ANOMALY_DETECTED", "medium", F.to_json(F.struct("agent_type", "confidence", "errors")))),
    ]
    second = results.select("evidence_id", (F.col("seq") * 3 + 5).alias("at"), F.posexplode(F.array(*from_results)).alias("k", "r")).filter("r is not null").select("evidence_id", (F.col("at") + F.col("k")).cast("int").alias("ord"), "r")
    return first.unionByName(second).select("evidence_id", "ord", "r.code", "r.severity", "r.detail")


#: The reasons that block_reasons gives, with their severities.
REASONS = [
    ("HIGH_DECEPTION_SCORE", "high"), ("HIGH_MANIPULATION_SCORE", "medium"), ("LOW_FUSION_SCORE", "high"), ("MISSING_CONTENT", "high"), ("IMPOSSIBLE_TIMELINE", "critical"),
    ("ANALYSIS_ERROR", "high"), ("LOW_AGENT_CONFIDENCE", "medium"), ("ANOMALY_DETECTED", "medium"),
]


def _routed(evidence: DataFrame, reasons: DataFrame, success: str | None, *more: Column) -> DataFrame:
    """evidence_id, _own (its rows of evidence), routing and ``more``, which may count code and severity: items and reasons are put under one
    another and grouped once, so no task holds both sides of a join sorted."""
    failed = ~F.coalesce(F.col(success), F.lit(True)) if success else F.lit(False)
    items = evidence.select("evidence_id", F.lit(1).alias("_own"), failed.alias("failed"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("severity"))
    why = reasons.filter("evidence_id is not null").select("evidence_id", F.lit(0).alias("_own"), F.lit(False).alias("failed"), "code", "severity")
    by = items.unionByName(why).groupBy("evidence_id").agg(
        F.sum("_own").alias("_own"),
        F.bool_or("failed").alias("failed"),
        *[F.bool_or(F.col("severity") == x).alias(x) for x in ("critical", "high", "medium")],
        F.bool_or(F.startswith("code", F.lit("MISSING_"))).alias("missing"),
        *more,
    )
    at = F.when(F.col("failed") | F.col("critical"), "blocked").when(F.col("high"), "review").when(F.col("missing"), "needs_docs").when(F.col("medium"), "review").otherwise("auto_ok")
    return by.filter("_own > 0").withColumn("routing", at).drop("failed", "critical", "high", "medium", "missing")


def routing(evidence: DataFrame, reasons: DataFrame, success: str | None = None) -> DataFrame:
    """SCR17: evidence_id and routing, a row for each of ``evidence``; an item without reasons is auto_ok."""
    return _routed(evidence, reasons, success).select("evidence_id", "routing", F.explode(F.array_repeat(F.lit(0), F.col("_own").cast("int"))).alias("_k")).drop("_k")


# What is said first where output is withheld.
WITHHELD = {
    "blocked": ("ROUTING_BLOCKED", "critical", "Case has critical issues that prevent any output"),
    "review": ("ROUTING_REVIEW", "high", "Case requires human review before client output"),
    "needs_docs": ("ROUTING_NEEDS_DOCS", "high", "Case is missing required documentation"),
}


def client_view(evidence: DataFrame, routed: DataFrame) -> DataFrame:
    """SCR18, FIL9: what clients may see: nothing but items that are auto_ok. There is no bypass."""
    allowed = routed.filter(F.col("routing") == "auto_ok").select("evidence_id")
    text = F.when(F.col("fused_class").isNotNull(), F.concat(F.lit("Analysis complete. Classification: "), "fused_class")).otherwise("Analysis complete. See full report for details.")
    return evidence.join(allowed, "evidence_id", "left_semi").select("evidence_id", "case_id", F.lit("complete").alias("status"), F.col("fused_class").alias("classification"), F.col("fused_score").alias("confidence"), text.alias("summary"))


def withheld(routed: DataFrame, reasons: DataFrame) -> DataFrame:
    """SCR18: all reasons of each withheld item, the routing's own first."""
    own = F.coalesce(*[F.when(F.col("routing") == k, reason(*v[:2], v[2])) for k, v in WITHHELD.items()])
    first = routed.filter(F.col("routing") != "auto_ok").select("evidence_id", F.lit(-1).alias("ord"), own.alias("r")).select("evidence_id", "ord", "r.*")
    return first.unionByName(reasons.join(routed.filter(F.col("routing") != "auto_ok").select("evidence_id"), "evidence_id", "left_semi"))


def withheld_counts(evidence: DataFrame, reasons: DataFrame, success: str | None = None) -> DataFrame:
    """SCR18: code, severity and n of ``withheld``, without the list: items are grouped once, with a counter for each reason of
    ``block_reasons`` (any other is an error)."""
    which = F.concat_ws("/", "code", "severity")
    known = [f"{c}/{x}" for c, x in REASONS]
    checked = reasons.withColumn("code", F.when(which.isin(known), F.col("code")).otherwise(F.raise_error(F.concat(F.lit("no such reason: "), which)).cast("string")))
    counters = [F.count_if((F.col("code") == c) & (F.col("severity") == x)).alias(f"_{k}") for k, (c, x) in enumerate(REASONS)]
    by = _routed(evidence, checked, success, *counters).filter("routing <> 'auto_ok'")
    own = [F.sum(F.when(F.col("routing") == k, F.col("_own")).otherwise(0)).alias(f"_r{i}") for i, k in enumerate(WITHHELD)]
    total = by.agg(*own, *[F.sum(F.col(f"_{k}")).alias(f"_{k}") for k in range(len(REASONS))])
    rows = [(v[0], v[1], f"_r{i}") for i, v in enumerate(WITHHELD.values())] + [(c, x, f"_{k}") for k, (c, x) in enumerate(REASONS)]
    return total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(x).alias("severity"), F.col(n).cast("long").alias("n")) for c, x, n in rows])).alias("w")).select("w.*").filter("n > 0")


def internal_view(evidence: DataFrame, routed: DataFrame, reasons: DataFrame) -> DataFrame:
    """FIL9: everything, for review queues."""
    listed = reasons.groupBy("evidence_id").agg(F.sort_array(F.collect_list(F.struct("ord", "code", "severity", "detail"))).alias("block_reasons"))
    return evidence.join(routed, "evidence_id").join(listed, "evidence_id", "left")


def score_rollup(results: DataFrame) -> DataFrame:
    """AGG3."""
    return results.groupBy("evidence_id").agg(
        F.count(F.lit(1)).alias("result_count"),
        F.sort_array(F.collect_set("agent_type")).alias("agents"),
        F.coalesce(F.avg(F.nullif("confidence", F.lit(0.0))), F.lit(0.0)).alias("mean_confidence"),
        F.sum("processing_time_ms").alias("total_time_ms"),
    )
