"""Personal data: base matches against plain regular expressions, trees against planted spans, odd rows."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from casefile.llm import pii
from casefile.llm.boosting import calibrated, fitted

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
SCHEMA = "doc_id long, text string"


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            good = [True, kind != 1 or all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(d) <= 19 and luhn(d), 8 <= len(d) <= 15]
            if good[kind]:
                out.append((kind, *m.span()))
    return sorted(out)


@pytest.mark.parametrize("signs", ["0011299 .-+()@ab_%", "01234567890123456789  .", "a@b.c-d%_+@. é", "+1 ()-.555 9"])
def test_base_equals_plain_patterns(signs):
    pick = random.Random(signs)
    for _ in range(8_000):
        text = "".join(pick.choice(signs) for _ in range(pick.randrange(60)))
        assert sorted(pii.base(text)[0]) == plain(text), text


def test_base_equals_plain_patterns_on_documents(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert sorted(pii.base(r["text"] or "")[0]) == plain(r["text"] or "")


def card(pick):
    d = "".join(str(pick.randrange(10)) for _ in range(15))
    return next(d + str(k) for k in range(10) if luhn(d + str(k)))


def phone(pick):
    return f"+1 ({pick.randrange(100, 999)}) 555-{pick.randrange(1000, 9999)}"


def corpus(n=900):
    pick = random.Random(5)
    rows = []
    for k in range(n):
        ip = ".".join(str(pick.randrange(1, 250)) for _ in range(4))
        wrong = "".join(str(pick.randrange(10)) for _ in range(16))
        rows.append((k, f"call me {phone(pick)}, pay {card(pick)} or {wrong} from {ip} mail x{k}@mail.example.com on 2024-05-{pick.randrange(10, 28)} ref {pick.randrange(10**8)} ok"))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.createDataFrame(corpus(), SCHEMA))


def test_spans_hidden_by_neighbours_are_added(spark, model):
    pick = random.Random(9)
    a, b, p = card(pick), card(pick), phone(pick)
    rows = [(1, f"pay {a} {b} now"), (2, f"call {p} 190.137.223.204 please"), (3, "ref 12345678 on 2024-05-12, version 1.2.3 of 10"), (4, f"only {p} here")]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert got[1]["spans"] == "card:4:20,card:21:37" and got[1]["n_card"] == 0
    assert got[2]["spans"] == f"ip:{6 + len(p)}:{21 + len(p)},phone:5:{5 + len(p)}" and got[2]["n_phone"] == 0
    assert got[3]["spans"] == "" and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[4]["spans"] == f"phone:5:{5 + len(p)}" and got[4]["n_added"] == 0 and got[4]["n_phone"] == 1


def test_base_spans_stay_and_reruns_and_partitions_agree(spark, model):
    rows = corpus(300)
    df = spark.createDataFrame(rows, SCHEMA)
    first = sorted(map(tuple, pii.personal_data(df, model).collect()))
    again = pii.fit(spark.createDataFrame(corpus(), SCHEMA).repartition(7))
    assert sorted(map(tuple, pii.personal_data(df.repartition(5), again).collect())) == first
    for (_, text), row in zip(rows, first):
        want = plain(text)
        assert row[1:5] == tuple(sum(k == x for k, *_ in want) for x in range(4))
        assert row[5] == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert set(pii.joined(want).split(",")) <= set(row[6].split(","))


def test_odd_rows(spark, model):
    rows = [(1, None), (None, ""), (2, "x@y.zz"), (2, "x@y.zz"), (3, "é " * 100_000 + "a@b.cc")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kind", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("n_email", F.lit("x"))
    got = sorted((str(r["doc_id"]), r["n_email"], r["spans"]) for r in pii.personal_data(df, model).collect())
    assert got == [("1", 0, ""), ("2", 1, "email:0:6"), ("2", 1, "email:0:6"), ("3", 1, "email:200000:200006"), ("None", 0, "")]
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.personal_data(empty, pii.fit(empty)).count() == 0


def test_redaction_keeps_other_columns(spark, model):
    df = spark.createDataFrame([(1, "to a@b.cc from 10.0.0.1!"), (2, None), (3, "nothing")], SCHEMA).withColumn("a.b", F.lit(7))
    got = sorted(map(tuple, pii.redact(df, model).collect()))
    assert got == [(1, "to [EMAIL] from [IP]!", 7), (2, None, 7), (3, "nothing", 7)]


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000 + "@", "+" * 300_000, "1." * 40_000, "1 " * 40_000, "a." * 100_000 + "@" + "b." * 100_000])
def test_hard_texts_take_linear_time(text, model):
    began = time.time()
    pii.found(text, model)
    assert time.time() - began < 60


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, (4_000, 5)).astype(float)
    y = ((x[:, 0] > 10) ^ (x[:, 3] > 5)).astype(float)
    trees = fitted(x[:3_000], y[:3_000], np.ones(3_000))
    score = trees.scores(x[3_000:])
    assert ((score > 0) == (y[3_000:] == 1)).mean() > 0.97
    rate = calibrated(score, y[3_000:], np.ones(1_000))
    assert (np.diff(rate.rate) >= -0.05).all() and rate(np.array([99.0]))[0] > 0.95 and rate(np.array([-99.0]))[0] == 0
