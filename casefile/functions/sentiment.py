"""SCR6: sentiment from a valence lexicon that the user supplies (word, valence)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.functions import text as t

# A simplified rule-based model: some negations, boosters and dampers, and normalisation (fixed values).
NEGATIONS = ["not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "cannot", "can't", "don't", "doesn't", "didn't", "isn't", "wasn't", "won't", "wouldn't", "shouldn't", "couldn't", "without"]
BOOSTERS = ["very", "really", "extremely", "absolutely", "completely", "so", "too", "totally"]
DAMPERS = ["slightly", "somewhat", "barely", "hardly", "almost", "kinda"]
NEGATED, BOOST, ALPHA = -0.74, 0.293, 15.0


def sentiment(docs: DataFrame, lexicon: DataFrame, text: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """doc_id, neg, pos, neu and compound: each word's valence, boosted or damped by the word before
    and turned by a negation among the three before; compound = s / sqrt(s^2 + 15). Texts without a
    known word are neutral (0, 0, 1, 0). The lexicon is broadcast if it has few rows."""
    words = F.transform(t.tokens(F.lower(text)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    # Each word takes the three before it along, so that no row carries the whole text.
    before = lambda i, n: F.when(i >= n, F.get("w", i - n)).alias(f"b{n}")
    near = F.transform("w", lambda x, i: F.struct(x.alias("word"), *[before(i, n) for n in (1, 2, 3)]))
    w = docs.select("doc_id", words.alias("w")).select("doc_id", F.explode(near).alias("x")).select("doc_id", "x.*")
    small = lexicon.count() <= broadcast_rows
    hit = w.join(F.broadcast(lexicon) if small else lexicon, "word", "left")
    sign = F.signum("valence")
    v = F.col("valence") + sign * F.when(F.col("b1").isin(BOOSTERS), BOOST).when(F.col("b1").isin(DAMPERS), -BOOST).otherwise(0.0)
    turned = F.coalesce(F.col("b1").isin(NEGATIONS) | F.coalesce(F.col("b2").isin(NEGATIONS), F.lit(False)) | F.coalesce(F.col("b3").isin(NEGATIONS), F.lit(False)), F.lit(False))
    v = F.coalesce(F.when(turned, v * NEGATED).otherwise(v), F.lit(0.0))
    x = hit.withColumn("v", v).groupBy("doc_id").agg(F.sum("v").alias("s"), F.sum(F.when(F.col("v") > 0, F.col("v") + 1).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("v") < 0, F.col("v") - 1).otherwise(0.0)).alias("n"), F.count_if(F.col("v") == 0).alias("z"))
    total = F.col("p") + F.abs("n") + F.col("z")
    out = docs.select("doc_id").join(x, "doc_id", "left")
    share = lambda c: F.coalesce(F.round(F.try_divide(c, total), 3), F.lit(0.0))
    return out.select("doc_id", share(F.abs("n")).alias("neg"), share(F.col("p")).alias("pos"), F.coalesce(F.round(F.try_divide(F.col("z"), total), 3), F.lit(1.0)).alias("neu"), F.coalesce(F.round(F.col("s") / F.sqrt(F.col("s") * F.col("s") + ALPHA), 4), F.lit(0.0)).alias("compound"))
