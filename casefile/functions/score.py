"""Scores of a text and their fusion, as column expressions (no shuffle, no Python)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions import text as t
from casefile.functions.lexicon import BEHAVIORS, Fusion, Lexicon


def one(value: Column) -> Column:
    return F.least(F.lit(1.0), value)


def hits(lowered: Column, phrases: list[str]) -> Column:
    """How many phrases occur: a sum of plain comparisons, which stays in generated code."""
    return reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(p.lower())).cast("int") for p in phrases], F.lit(0)).cast("double")


def pattern_hits(lowered: Column, patterns: list[str]) -> Column:
    """How many patterns occur; literal patterns are compiled once in a task."""
    return reduce(lambda a, b: a + b, [lowered.rlike(p).cast("int") for p in patterns], F.lit(0)).cast("double")


def per(words: Column, n: int) -> Column:
    """Word count in units of n, one at least."""
    return F.greatest(words / F.lit(float(n)), F.lit(1.0))


def with_scores(df: DataFrame, text: str = "text", lexicon: Lexicon | None = None) -> DataFrame:
    """SCR1-SCR5: darvo, gaslighting, manipulation, deception, hedging, certainty and emotional.

    Adds one column each, in [0, 1]; a null text scores like an empty one. Lower-casing and counts
    of words are computed once, in a projection below the scores; the scores stay in generated code.
    """
    x = lexicon or Lexicon()
    base = df.withColumns({"_low": F.lower(F.coalesce(F.col(text), F.lit(""))), "_words": t.word_count(text).cast("double"), "_caps": t.caps_count(text)})
    low, words = F.col("_low"), F.col("_words")
    base = base.withColumns({
        "darvo": one(hits(low, x.darvo) / F.greatest(words, F.lit(1.0)) * 100 / 5),
        "gaslighting": one((hits(low, x.gaslighting) + pattern_hits(low, x.gaslighting_patterns)) / 5),
    })
    return base.withColumns({
        "manipulation": one(F.col("darvo") * 0.4 + F.col("gaslighting") * 0.4 + F.least(F.lit(0.2), hits(low, x.manipulation) * 0.05)),
        "deception": one((hits(low, x.qualifiers) + hits(low, x.distancing) * 0.5 + hits(low, x.formal) * 0.3) / per(words, 50)),
        "hedging": one(hits(low, x.hedges) / per(words, 20)),
        "certainty": one(hits(low, x.certainty) / per(words, 20)),
        "emotional": one((t.exclamations(text) * 0.1 + F.col("_caps") * 0.1 + hits(low, x.emotions) * 0.2) / per(words, 50)),
    }).drop("_low", "_words", "_caps")


def probabilities(darvo: Column, gaslighting: Column) -> Column:
    """SCR7: classes with their probabilities, in a fixed order that settles ties."""
    raw = [F.greatest(F.lit(0.0), 1 - F.greatest(darvo, gaslighting) * 1.5), darvo, gaslighting, (darvo + gaslighting) / 2, F.lit(0.0), F.lit(0.0)]
    total = reduce(lambda a, b: a + b, raw)
    return F.array(*[F.struct(F.lit(c).alias("cls"), F.when(total > 0, p / total).otherwise(p).alias("p")) for c, p in zip(BEHAVIORS, raw)])


def first_maximum(probs: Column) -> Column:
    best = F.array_max(F.transform(probs, lambda s: s["p"]))
    return F.get(F.filter(probs, lambda s: s["p"] == best), F.lit(0))


def ranked(probs: Column) -> Column:
    """SRT4: probabilities in falling order; equal ones stay in theirs."""
    at = F.transform(probs, lambda s, i: F.struct((-s["p"]).alias("down"), i.alias("i"), s["cls"].alias("cls"), s["p"].alias("p")))
    return F.transform(F.array_sort(at), lambda s: F.struct(s["cls"], s["p"]))


def behavioral_confidence(d: Column, g: Column, m: Column, embedded: Column) -> Column:
    """SCR8, with JOIN9's boost where embeddings exist."""
    base = 0.5 + F.abs((d + g + m) / 3 - 0.5) * 2 * 0.3
    return one(base + F.when(embedded, 0.1).otherwise(0.0))


def severity(d: Column, g: Column, m: Column, deception: Column) -> Column:
    """SCR9."""
    s = d * 0.3 + g * 0.3 + m * 0.25 + deception * 0.15
    many = sum((F.when(c > 0.3, 1).otherwise(0) for c in (d, g, m)), F.lit(0)) >= 2
    return F.when(many, one(s * 1.2)).otherwise(s)


def fused(severity_: Column, ocr: Column, mean_confidence: Column, alpha: float = Fusion.alpha) -> Column:
    """SCR10: severity weighed by OCR quality, and the mean confidence of successful results. A null
    severity (no indicators) gives half the OCR confidence."""
    quality = F.when(F.coalesce(ocr, F.lit(0.0)) == 0, F.lit(0.5)).otherwise(ocr)
    both = alpha * severity_ * F.least(F.lit(1.0), quality + 0.2) + (1 - alpha) * F.coalesce(mean_confidence, F.lit(0.5))
    return F.coalesce(both, quality * 0.5)


def banded(score: Column, names: list[str]) -> Column:
    """Five bands at 0.2, 0.4, 0.6 and 0.8."""
    out = F.when(score < 0.2, names[0])
    for limit, name in zip((0.4, 0.6, 0.8), names[1:4]):
        out = out.when(score < limit, name)
    return out.otherwise(names[4])


CONCERN = ["low_concern", "moderate_concern", "elevated_concern", "high_concern", "critical_concern"]
BANDS = ["low", "moderate", "elevated", "high", "critical"]


def fused_class(probs: Column, score: Column) -> Column:
    """SCR12: the first class of maximal probability if over one half, else a band of concern."""
    best = first_maximum(probs)
    return F.when(best["p"] > 0.5, best["cls"]).otherwise(banded(score, CONCERN))


def status(score: Column, failed: Column | None = None, above: float = Fusion.flag_above) -> Column:
    """SCR24."""
    out = F.when(failed, "error") if failed is not None else F.when(F.lit(False), "")
    return out.when(score > above, "flagged").otherwise("analyzed")


def risk_tier(score: Column) -> Column:
    """SCR25."""
    return F.when(score > 0.75, "high").when(score > 0.4, "moderate").otherwise("low")


def warnings(*pairs: tuple[Column, str]) -> Column:
    """Texts of the conditions that hold."""
    return F.filter(F.array(*[F.when(c, F.lit(w)) for c, w in pairs]), lambda w: w.isNotNull())


def risk_of(found: Column, high: int = 3) -> Column:
    n = F.size(found)
    return F.when(n >= high, "high").when(n >= 1, "medium").otherwise("low")


def spoof_warnings(spf: Column, auth: Column, from_: Column, reply_to: Column, hops: Column) -> Column:
    """SCR13: SPF (soft failure looked for first), DKIM, DMARC, reply address, display name and hops."""
    spf, auth = F.lower(F.coalesce(spf, F.lit(""))), F.lower(F.coalesce(auth, F.lit("")))
    failed = ~F.contains(spf, F.lit("pass"))
    own = t.domain(t.sender(from_))
    shown = t.domain(F.regexp_extract(F.regexp_replace(from_, r"<[^>]*>", ""), t.ADDRESS, 0))
    return warnings(
        (failed & F.contains(spf, F.lit("softfail")), "spf_softfail"),
        (failed & F.contains(spf, F.lit("fail")) & ~F.contains(spf, F.lit("softfail")), "spf_fail"),
        (F.contains(auth, F.lit("dkim=fail")), "dkim_fail"),
        (F.contains(auth, F.lit("dmarc=fail")), "dmarc_fail"),
        ((F.regexp_extract(F.coalesce(reply_to, F.lit("")), t.ADDRESS, 0) != "") & (t.address(reply_to) != t.sender(from_)), "reply_to_mismatch"),
        ((shown != "") & (shown != own), "display_name_mismatch"),
        (hops > 10, "many_hops"),
    )


def tamper_warnings(m: dict[str, Column]) -> Column:
    """SCR19 over document metadata: created, modified (text), revisions, hidden, structure (bool),
    author, creator, has_metadata (bool), macro_risk."""
    made, changed = F.try_to_timestamp(m["created"]), F.try_to_timestamp(m["modified"])
    later = F.coalesce(made > changed, m["created"] > m["modified"], F.lit(False))
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    return warnings(
        (later, "timestamp_anomaly"),
        (m["revisions"] > 50, "many_revisions"),
        ((m["hidden"] > 10) | m["structure"], "hidden_content"),
        (m["has_metadata"] & none(m["author"]) & none(m["creator"]), "no_author"),
        (m["has_metadata"] & none(m["created"]), "no_creation_date"),
        (m["macro_risk"].isin("medium", "high"), "macros"),
    )


def tamper_risk(found: Column) -> Column:
    return F.when((F.size(found) >= 3) | F.array_contains(found, "timestamp_anomaly"), "high").when(F.size(found) >= 1, "medium").otherwise("low")


def macro_risk(macros: Column, autoexec: Column, suspicious: Column, iocs: Column) -> Column:
    """SCR20, from counts."""
    return F.when((iocs > 0) | (suspicious > 3), "high").when((autoexec > 0) | (suspicious > 0), "medium").when(macros > 0, "low").otherwise("none")


def image_risk(ela: Column, noise: Column, double: Column) -> Column:
    """SCR22."""
    return risk_of(warnings((ela > 0.15, "ela"), (noise > 0.2, "noise"), (double, "double_compression")), high=2)


def extraction_confidence(kind: Column, f: dict[str, Column]) -> Column:
    """SCR21, by kind. ``f``: has_text, has_metadata, risk, failed, headers (of from, to, subject and
    date), spf_pass, dkim_pass, dmarc_pass, has_exif, frames, transcribed, lang_prob."""
    plus = lambda c, v: F.when(c, v).otherwise(0.0)
    by_risk = lambda *v: F.when(f["risk"] == "high", v[0]).when(f["risk"] == "medium", v[1]).when(f["risk"] == "low", v[2]).otherwise(0.0)
    document = 0.85 + plus(f["has_text"], 0.05) + plus(f["has_metadata"], 0.05) + by_risk(-0.2, -0.1, 0.0) - plus(f["failed"], 0.15)
    email = 0.8 + 0.1 * f["headers"] / 4 + plus(f["spf_pass"], 0.03) + plus(f["dkim_pass"], 0.03) + plus(f["dmarc_pass"], 0.04)
    image = 0.8 + plus(f["has_exif"], 0.1) + by_risk(0.0, 0.05, 0.1)
    video = 0.7 + plus(f["frames"] > 0, 0.1) + F.when(f["transcribed"], 0.1 + 0.1 * F.coalesce(f["lang_prob"], F.lit(0.0))).otherwise(0.0)
    value = F.when(kind == "document", document).when(kind == "email", email).when(kind == "image", image).when(kind == "video", video)
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def critique(kind: Column, f: dict[str, Column]) -> Column:
    """SCR23: how good a result is, by the kind of its analyser. ``f``: ok, confidence, findings
    (number), chars, both_patterns, consistency, anomalies, agents, labels, relations, risk,
    has_exif, verified, has_metadata, words, engines, engine_variance, speakers, seconds, scenes,
    has_audio."""
    c = f["confidence"]
    plus = lambda x, cond, v: F.when(cond, one(x + v)).otherwise(x)
    short = lambda n, few, some: c * F.when(n < few, 0.5).when(n < some, 0.8).otherwise(1.0)
    risky = c * F.when(f["risk"] == "high", 0.7).when(f["risk"] == "medium", 0.85).otherwise(1.0)
    fusion = c * F.when(f["consistency"] < 0.5, 0.7).otherwise(1.0)
    fusion = fusion * F.when(f["anomalies"] > 0, F.greatest(F.lit(0.5), 1.0 - f["anomalies"] * 0.1)).otherwise(1.0)
    value = (
        F.when(kind == "behavioral", plus(c * F.when(f["chars"] < 50, 0.6).when(f["chars"] < 100, 0.8).otherwise(1.0), f["both_patterns"], 0.05))
        .when(kind == "fusion", plus(fusion, f["agents"] >= 2, 0.05))
        .when(kind == "entity", plus(plus(c, f["labels"] >= 3, 0.1), f["relations"] > 0, 0.05))
        .when(kind == "email", risky)
        .when(kind == "image", plus(risky, f["has_exif"], 0.05))
        .when(kind == "document", plus(plus(risky, f["verified"], 0.05), f["has_metadata"], 0.03))
        .when(kind == "ocr", plus(short(f["words"], 5, 20), (f["engines"] > 1) & (f["engine_variance"] < 0.05), 0.1))
        .when(kind == "audio", plus(short(f["words"], 10, 50), f["speakers"] > 1, 0.1))
        .when(kind == "video", plus(plus(short(f["seconds"], 1, 5), f["scenes"] > 0, 0.05), f["has_audio"], 0.1))
        .otherwise(one(c + F.least(F.lit(0.1), f["findings"] * 0.02)))
    )
    return F.when(f["ok"], value).otherwise(0.0)


# How fast a scaled worker count falls.
WORKERS = {"critical": 0.25, "hot": 0.5, "warm": 0.75}


def thermal_state(temperature: Column) -> Column:
    """SCR26."""
    return F.when(temperature < 70, "normal").when(temperature < 80, "warm").when(temperature < 85, "hot").otherwise("critical")


def throttle_reason(power: Column, vram_mb: Column, thermal: Column) -> Column:
    """SCR26: why to throttle; null for no reason."""
    return F.when(power == "battery", "battery_power").when(vram_mb > 23040, "vram_critical").when(vram_mb > 21504, "vram_high").when(thermal == "critical", "thermal_critical").when(thermal == "hot", "thermal_hot")


def workers(base: Column, power: Column, thermal: Column) -> Column:
    """SCR26: workers by power and temperature, one at least."""
    n = F.floor(base * F.when(power == "battery", 0.5).otherwise(1.0))
    share = F.lit(1.0)
    for state, part in WORKERS.items():
        share = F.when(thermal == state, part).otherwise(share)
    return F.greatest(F.lit(1).cast("long"), F.floor(n * share))
