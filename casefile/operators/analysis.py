"""From evidence to the gate in one plan: named stages with hooks, and the contract of analysers.

A stage is a function from a DataFrame to a DataFrame. Stages add columns only, so Catalyst sees one
plan from the scan to the gate: no stage shuffles, and what no later stage reads is pruned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions import ingest, score
from casefile.functions import text as t
from casefile.functions.lexicon import Fusion, Lexicon

Stage = Callable[[DataFrame], DataFrame]


@runtime_checkable
class Analyser(Protocol):
    """Anything with a name that adds its findings as columns: ``Stages.insert`` takes it as a stage."""

    name: str

    def apply(self, df: DataFrame) -> DataFrame: ...


#: What a critique asks of a result, and what it takes where an analyser does not say.
CRITIQUE = {"chars": 0, "both_patterns": False, "consistency": 1.0, "anomalies": 0, "agents": 0, "labels": 0, "relations": 0, "risk": "low", "has_exif": False, "verified": False, "has_metadata": False, "words": 0, "engines": 0, "engine_variance": 1.0, "speakers": 0, "seconds": 0.0, "scenes": 0, "has_audio": False}
RESULTS = "evidence_id, seq, agent_type, confidence, findings, errors, critique"


@dataclass(frozen=True)
class ResultAnalyser:
    """An analyser whose findings are rows of results: expressions over evidence rows for its confidence, its findings (name to
    column), its error (null if there is none) and what its critique of itself asks (see CRITIQUE)."""

    agent_type: str
    confidence: Column
    findings: dict[str, Column]
    error: Column | None = None
    asked: dict[str, Column] = field(default_factory=dict)

    def row(self, seq: Column) -> Column:
        """The result as a struct. One with an error has no confidence, and its critique is 0."""
        error = F.lit(None).cast("string") if self.error is None else self.error
        ok, sure = error.isNull(), F.when(error.isNull(), self.confidence).otherwise(0.0)
        asked = {k: self.asked.get(k, F.lit(v)) for k, v in CRITIQUE.items()}
        worth = score.critique(F.lit(self.agent_type), {"ok": ok, "confidence": sure, "findings": F.lit(len(self.findings)), **asked})
        errors = F.when(ok, F.array().cast("array<string>")).otherwise(F.array(error))
        return F.struct(seq.cast("int").alias("seq"), F.lit(self.agent_type).alias("agent_type"), sure.alias("confidence"), F.to_json(F.struct(*[c.alias(k) for k, c in self.findings.items()])).alias("findings"), errors.alias("errors"), worth.alias("critique"))

    def apply(self, evidence: DataFrame, results: DataFrame) -> DataFrame:
        """``results`` with a row more for each item of evidence, whose seq follows the item's last."""
        last = results.groupBy("evidence_id").agg((F.max("seq") + 1).alias("_seq"))
        new = evidence.join(last, "evidence_id", "left").select("evidence_id", self.row(F.coalesce("_seq", F.lit(0))).alias("r")).select("evidence_id", "r.*")
        return results.unionByName(new, allowMissingColumns=True)


def result_rows(evidence: DataFrame, analysers: list[ResultAnalyser]) -> DataFrame:
    """The results of several analysers over the same evidence, in one pass without a shuffle."""
    rows = F.array(*[a.row(F.lit(k)) for k, a in enumerate(analysers)])
    return evidence.select("evidence_id", F.explode(rows).alias("r")).select("evidence_id", "r.*")


def standard_analysers() -> list[ResultAnalyser]:
    """Behavior and fusion over rows that have passed the stages up to the gate."""
    scores = {c: F.col(c) for c in ("darvo", "gaslighting", "manipulation", "deception", "primary_class")}
    behavioral = ResultAnalyser("behavioral", F.col("confidence"), scores, F.col("error"), {"chars": F.length("text"), "both_patterns": (F.col("darvo") > 0) & (F.col("gaslighting") > 0)})
    fused = ResultAnalyser("fusion", F.col("fused_score"), {c: F.col(c) for c in ("fused_score", "fused_class", "tier")}, F.col("error"), {"agents": F.lit(1)})
    return [behavioral, fused]


@dataclass
class Stages:
    """Named stages in their order; hooks run before (``pre``) or after a stage."""

    steps: list[tuple[str, Stage]]
    pre: dict[str, list[Stage]] = field(default_factory=dict)
    post: dict[str, list[Stage]] = field(default_factory=dict)

    def names(self) -> list[str]:
        return [name for name, _ in self.steps]

    def _at(self, name: str) -> int:
        if name not in self.names():
            raise KeyError(f"no stage {name!r}; there are {', '.join(self.names())}")
        return self.names().index(name)

    def add_hook(self, stage: str, hook: Stage, pre: bool = True) -> Stages:
        self._at(stage)
        (self.pre if pre else self.post).setdefault(stage, []).append(hook)
        return self

    def insert(self, analyser: Analyser, after: str) -> Stages:
        if analyser.name in self.names():
            raise ValueError(f"there is a stage {analyser.name!r} already")
        self.steps.insert(self._at(after) + 1, (analyser.name, analyser.apply))
        return self

    def replace(self, stage: str, step: Stage) -> Stages:
        self.steps[self._at(stage)] = stage, step
        return self

    def run(self, df: DataFrame) -> DataFrame:
        for name, step in self.steps:
            for f in (*self.pre.get(name, ()), step, *self.post.get(name, ())):
                df = f(df)
        return df


def intake(df: DataFrame) -> DataFrame:
    """FIL5-FIL8: error of rows without content, the best text, what still needs OCR, and the stages
    that apply. Rows have evidence_type, text and raw (bytes); either of these may be null."""
    best = t.best_text("text", "raw")
    return df.withColumns({"error": ingest.intake_error("text", "raw"), "needs_ocr": ingest.needs_ocr(F.col("evidence_type"), best), "stages": ingest.route(F.col("evidence_type")), "text": best})


def behavior(df: DataFrame, embedded: Column | None = None) -> DataFrame:
    """SCR7-SCR10, SCR12, SCR24 and SCR25 on scored rows: probs, confidence, severity, fused_score,
    primary_class, primary_p, fused_class, status and tier. ``embedded``: where embeddings exist."""
    d, g, m = F.col("darvo"), F.col("gaslighting"), F.col("manipulation")
    df = df.withColumns({"probs": score.probabilities(d, g), "confidence": score.behavioral_confidence(d, g, m, F.lit(False) if embedded is None else embedded), "severity": score.severity(d, g, m, F.col("deception"))})
    df = df.withColumn("fused_score", score.fused(F.col("severity"), F.lit(None).cast("double"), F.col("confidence")))
    best = score.first_maximum(F.col("probs"))
    return df.withColumns({"primary_class": best["cls"], "primary_p": best["p"], "fused_class": score.fused_class(F.col("probs"), F.col("fused_score")), "status": score.status(F.col("fused_score")), "tier": score.risk_tier(F.col("fused_score"))})


def gate(df: DataFrame, fusion: Fusion = Fusion()) -> DataFrame:
    """SCR17 on a row's own scores: routing. Rows without content (error) are blocked."""
    high = (F.col("deception") > fusion.deception) | (F.col("fused_score") < fusion.least_score) | (F.length(F.trim(F.coalesce("text", F.lit("")))) < fusion.least_chars)
    blocked = F.col("error").isNotNull() if "error" in df.columns else F.lit(False)
    return df.withColumn("routing", F.when(blocked, "blocked").when(high | (F.col("manipulation") > fusion.manipulation), "review").otherwise("auto_ok"))


def evidence_stages(lexicon: Lexicon | None = None, fusion: Fusion = Fusion(), embedded: Column | None = None) -> Stages:
    """The stages intake, scores, behavior and gate."""
    return Stages([("intake", intake), ("scores", lambda df: score.with_scores(df, lexicon=lexicon)), ("behavior", lambda df: behavior(df, embedded)), ("gate", lambda df: gate(df, fusion))])
