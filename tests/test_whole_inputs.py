"""Registered queries read their tables whole: against brute force on small fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from casefile.operators import entities
from casefile.plans import table_queries, text_queries
from casefile.plans.catalog import QUERIES

LONG = "x@early.org " + "word " * 200 + "SSN 123-45-6789 card 4111111111111111 see https://early.example/p. " + "word " * 200 + "end."


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("documents"))
    rows = [(0, LONG, "s"), (14, "short", "s"), (29, "y@short.org", "s"), (44, "", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    return d


def texts_of(spark, d):
    return {r["doc_id"]: r["text"] for r in text_queries.phrases(spark, d).collect()}


def test_phrases_hold_whole_documents(spark, documents):
    got = texts_of(spark, documents)
    assert got[0].endswith(" " + LONG) and got[14].endswith(" short")


def test_mentions_of_whole_texts(spark, documents):
    whole = texts_of(spark, documents)
    got = {tuple(r) for r in QUERIES["str5_pattern_mentions"](spark, documents).select("doc_id", "label", "pattern", "start", "end").collect()}
    want = set()
    for i, text in whole.items():
        for label, patterns in entities.PATTERNS.items():
            want |= {(i, label, k, *m.span()) for k, p in enumerate(patterns) for m in re.finditer(p, text, re.I | re.A)}
    assert got == want
    labels = {(r["doc_id"], r["label"]) for r in QUERIES["str6_personal_mentions"](spark, documents).collect()}
    assert {(0, "PII_EMAIL"), (0, "PII_SSN"), (0, "PII_CREDIT_CARD"), (29, "PII_EMAIL")} <= labels
    counts = {r["label"]: r["n"] for r in QUERIES["agg10_pii_by_type"](spark, documents).collect()}
    assert counts["PII_EMAIL"] == 2
    assert ("EMAIL", "x@early.org") in {(r["label"], r["text"].lower()) for r in QUERIES["set1_deduplicated_mentions"](spark, documents).collect()}


def test_redacted_and_masked_texts_are_whole(spark, documents):
    for name in ("str11_redact", "str12_mask"):
        got = {r["doc_id"]: r["text"] for r in QUERIES[name](spark, documents).collect()}
        assert got[0].count("word ") == 400 and got[0].endswith("end.")
        assert "x@early" not in got[0] and "123-45" not in got[0] and "411111111111" not in got[0]


def test_urls_of_whole_texts(spark, documents):
    got = {r["doc_id"]: r["urls"] for r in QUERIES["str7_urls"](spark, documents).collect()}
    assert got[0] == "https://early.example/p"
