"""Stages, hooks and the contract of analysers; changed lexicons and weights; linear spans."""

import re
import time

import pytest
from pyspark.sql import functions as F

from casefile.functions import score
from casefile.functions.lexicon import Fusion, Lexicon
from casefile.operators import analysis, entities


@pytest.fixture()
def rows(spark):
    data = [
        (1, "text", "You always do this and it's your fault! " * 3, None),
        (2, "image", None, b"Maybe, perhaps, I guess it could be so; a long enough text."),
        (3, "document", "", b""),
        (4, None, None, None),
        (5, "text", "short", None),
        (5, "text", "short", None),
    ]
    return spark.createDataFrame(data, "evidence_id long, evidence_type string, text string, raw binary")


def test_from_evidence_to_the_gate(rows):
    got = {r["evidence_id"]: r for r in analysis.evidence_stages().run(rows).collect()}
    assert {k: r["routing"] for k, r in got.items()} == {1: "auto_ok", 2: "review", 3: "blocked", 4: "blocked", 5: "review"}
    assert got[1]["darvo"] > 0 and got[2]["hedging"] == 1.0 and got[2]["text"].startswith("Maybe")
    assert got[3]["error"] and got[3]["needs_ocr"] and not got[2]["needs_ocr"] and got[4]["stages"] == ["behavioral", "fusion"]
    assert analysis.evidence_stages().run(rows.limit(0)).count() == 0


def test_hooks_and_analysers(rows):
    class Length:
        name = "length"

        def apply(self, df):
            return df.withColumn("chars", F.length("text"))

    seen = []

    def note(name):
        return lambda df: (seen.append(name), df)[1]

    stages = analysis.evidence_stages().add_hook("scores", note("before")).add_hook("scores", note("after"), pre=False)
    stages.add_hook("intake", lambda df: df.filter("evidence_id < 3"))
    assert isinstance(Length(), analysis.Analyser)
    stages.insert(Length(), after="intake").replace("gate", lambda df: df.withColumn("routing", F.lit("held")))
    assert stages.names() == ["intake", "length", "scores", "behavior", "gate"]
    got = stages.run(rows).collect()
    assert seen == ["before", "after"] and {(r["evidence_id"], r["routing"]) for r in got} == {(1, "held"), (2, "held")}
    assert all(r["chars"] == len(r["text"]) for r in got)
    with pytest.raises(KeyError):
        stages.add_hook("none", note("x"))
    with pytest.raises(ValueError):
        stages.insert(Length(), after="gate")


def test_changed_lexicon_and_weights(rows):
    one = rows.filter("evidence_id = 5").limit(1)
    plain = analysis.evidence_stages().run(one).first()
    other = analysis.evidence_stages(Lexicon(darvo=["short"], gaslighting=[], gaslighting_patterns=[]), Fusion(least_chars=1, least_score=0.0)).run(one).first()
    assert plain["darvo"] == 0 and other["darvo"] == 1.0 and plain["routing"] == "review" and other["routing"] == "auto_ok"


def test_scores_stay_in_generated_code(rows):
    plan = score.with_scores(rows).select("gaslighting", "deception", "hedging")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("*(") >= 1


def test_ranked_probabilities(spark):
    df = spark.createDataFrame([([("a", 0.2), ("b", 0.5), ("c", 0.2), ("d", 0.1)],)], "p array<struct<cls:string,p:double>>")
    assert [x["cls"] for x in df.select(score.ranked(F.col("p")).alias("r")).first()["r"]] == ["b", "a", "c", "d"]


def test_spans_of_long_texts(spark):
    text = "é1 22 - 333;" * 20_000
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "7"), (4, "7")], "doc_id long, text string")
    begin = time.time()
    got = sorted((r["doc_id"], r["start"], r["end"], r["text"]) for r in entities.spans(docs, "text", {"N": [r"\d+"]}).collect())
    assert time.time() - begin < 60
    assert got == [(1, *m.span(), m[0]) for m in re.finditer(r"\d+", text)] + [(4, 0, 1, "7")] * 2


def test_relations_take_the_sentence_of_a_mention(spark):
    docs = spark.createDataFrame([(1, "Anna called Bob. Carl met Anna! Bob paid"), (2, "Anna called Bob")], "doc_id long, text string")
    mentions = entities.pattern_mentions(docs, patterns={"PERSON": [r"Anna|Bob|Carl"]}, flags="")
    got = {(r["doc_id"], r["verb"], r["source"], r["target"]) for r in entities.relations(docs, mentions).collect()}
    assert got == {(1, "called", "Anna", "Bob"), (1, "called", "Bob", "Anna"), (1, "met", "Carl", "Anna"), (1, "met", "Anna", "Carl"), (2, "called", "Anna", "Bob"), (2, "called", "Bob", "Anna")}
