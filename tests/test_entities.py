"""Searching for mentions and rewriting texts: against Python's expressions, on hostile and on very long texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from casefile.operators import entities

PARTS = [
    "+1 (555) 123-4567", "5551234567", "555.123.4567", "a.b@example.com", "x_%@y.co.uk", "a@b.cd@e.fg", "123-45-6789", "123 45 6789", "4111111111111111", "378282246310005", "$1,234.50", "$,", "USD 20", "eur5", "20 dollars", "7 Pounds", "Case: 1-20-CV-3", "1:20-cv-12345", "AB-1234-5678",
    "18 U.S.C. 1030", "45 CFR § 46.1", "Roe v. Wade, 410 U. 113", "1/2/2024", "2024-05-06", "Jan. 5, 2024", "SEPTEMBER 12 1999", "10:30 PM", "10:30:01", "10.0.0.1", "https://example.org/x?y=1", "www.a.bc", "HTTP://Q.r", "word", " é ", "\U0001f600", "", "", ",", ".", " ", " ", "\n", "0", "99", "v", "A", " uſd 5", " K ",
]


def brute(text, flags):
    out = []
    for label, patterns in entities.PATTERNS.items():
        for k, p in enumerate(patterns):
            out += [(label, k, *m.span(), m[0]) for m in re.finditer(p, text, flags)]
    return sorted(out)


def test_matches_equal_pythons(spark):
    pick = random.Random(4)
    rows = [(i, "".join(pick.choice(PARTS) + pick.choice(["", " ", ""]) for _ in range(pick.randrange(1, 25)))) for i in range(1_500)]
    got = {}
    for r in entities.pattern_mentions(spark.createDataFrame(rows, "doc_id long, text string"), flags="(?i)").collect():
        got.setdefault(r["doc_id"], []).append((r["label"], r["pattern"], r["start"], r["end"], r["text"]))
    for i, text in rows:
        # Java's (?i) ignores case of ASCII letters only.
        assert sorted(got.get(i, [])) == brute(text, re.I | re.A), text


def test_unicode_case_is_not_lost_by_the_filter(spark):
    text = "pay UſD 5 now, wwW.Kelvin.example"
    got = {(r["label"], r["text"]) for r in entities.pattern_mentions(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert ("MONEY", "UſD 5") in got and ("URL", "wwW.Kelvin.example") in got


def test_private_signs_in_texts_stay(spark):
    text = "a@b.cd  10.0.0.1"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r["start"], r["end"], r["text"]) for r in entities.spans(df, "text", {"X": [r"[^ ]+"]}).collect())
    assert got == [(m.start(), m.end(), m[0]) for m in re.finditer("[^ ]+", text)]
    m = entities.pattern_mentions(df)
    assert {r["doc_id"]: r["text"] for r in entities.redact(df, m.withColumn("label", F.lit("PII_EMAIL"))).collect()} == {1: "[EMAIL REDACTED]  [EMAIL REDACTED]", 2: None, 3: ""}


def test_a_text_with_very_many_mentions_takes_linear_time(spark):
    took = []
    for n in (10_000, 100_000):
        text = "é mail a@b.cd and " * n
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begin = time.time()
        got = entities.redact(df, entities.pattern_mentions(df, patterns={"EMAIL": entities.PATTERNS["EMAIL"]})).first()["text"]
        took.append(time.time() - begin)
        assert got == "é mail [REDACTED] and " * n
    assert took[1] < 60 and took[1] < 15 * max(took[0], 2)


def test_rewriting_at_every_place(spark):
    pick = random.Random(8)
    rows, spans, want = [], [], {}
    for i in range(60):
        text = "".join(pick.choice("ab é\U0001f600\n") for _ in range(pick.choice([0, 1, 127, 128, 129, 256, 700])))
        at = sorted({pick.randrange(len(text) + 1) for _ in range(pick.choice([2, 6, 40]))})
        own = list(zip(at[::2], at[1::2]))
        rows.append((i, text))
        spans += [(i, a, b, "PERSON") for a, b in own]
        for a, b in reversed(own):
            text = text[:a] + "[NAME REDACTED]" + text[b:]
        want[i] = text
    docs, mentions = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(spans, "doc_id long, start int, end int, label string")
    assert {r["doc_id"]: r["text"] for r in entities.redact(docs, mentions).collect()} == want
    hidden = {r["doc_id"]: r["text"] for r in entities.mask(docs, mentions).collect()}
    assert all(len(hidden[i]) == len(text) for i, text in rows)


@pytest.mark.parametrize("flags", ["(?i)", "(?iu)", "(?U)", ""])
def test_needs_are_no_stricter_than_patterns(spark, flags):
    pick = random.Random(7)
    rows = [(i, "".join(pick.choice(PARTS) for _ in range(8))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    with_needs = entities.spans(df, "text", entities.PATTERNS, flags).count()
    plain = sum(df.select(F.sum(F.regexp_count("text", F.lit(flags + p)))).first()[0] for ps in entities.PATTERNS.values() for p in ps)
    assert with_needs == plain
