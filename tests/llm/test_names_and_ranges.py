"""Columns of any names, and ranges that no driver-side sketch makes."""

import random

import pytest
from pyspark.sql import functions as F

from casefile.llm import huffman, mixing, near_duplicates
from casefile.llm.ranks import range_bounds, ranked

ODD = ["a.b", "_row", "_size", "_of", "_parts", "step", "block", "node", "first", "bands", "c0", "other_3", "x y"]


@pytest.fixture(scope="module")
def docs(spark):
    pick = random.Random(1)
    rows = [(k, " ".join(pick.choice("abcdefgh") * 3 for _ in range(pick.randrange(60))), pick.choice(["s", "t", None])) for k in range(80)]
    rows += [(200 + k, r[1] + " end", r[2]) for k, r in enumerate(rows[:20])] + [(300, None, "s"), (301, "", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def wide(docs):
    for k, name in enumerate(ODD):
        docs = docs.withColumn(name, F.lit(k))
    return docs


def test_mixture_with_odd_names(docs):
    key = lambda df: sorted(map(tuple, df.select("doc_id", "size", "source_size", "target").collect()), key=repr)
    got = mixing.mix_digest(wide(docs))
    assert key(got) == key(mixing.mix_digest(docs))
    texts = mixing.mix_texts(wide(docs))
    assert texts.columns == wide(docs).columns and texts.select("`a.b`", "_row", "_size").distinct().collect() == [(0, 1, 2)]
    taken = {r["doc_id"]: r["taken"] for r in got.collect()}
    back = {}
    for r in texts.collect():
        back[r["doc_id"]] = back.get(r["doc_id"], 0) + len(r["text"].split())
    assert back == {k: v for k, v in taken.items() if v}


def test_near_duplicates_with_odd_names(docs):
    plain = sorted(map(tuple, near_duplicates.one_of_each(docs).collect()), key=repr)
    got = near_duplicates.one_of_each(wide(docs))
    assert got.columns == wide(docs).columns
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in got.filter("doc_id < 300").collect() if r["source"]) == sorted(r for r in plain if r[0] < 300 and r[2])
    assert {r["_row"] for r in got.collect()} == {1}


@pytest.mark.parametrize("n", [1, 2, 7, 5_000])
def test_bounds_cut_rows_evenly(spark, n):
    df = spark.range(20_000).select(F.when(F.col("id") % 50 > 0, F.col("id") * 3).alias("x"))
    bounds = range_bounds(df, "x", n)
    assert bounds == sorted(set(bounds)) and len(bounds) <= 2 * n
    if n == 7:
        counts = [0] * (len(bounds) + 1)
        for r in df.filter("x is not null").collect():
            counts[sum(b <= r["x"] for b in bounds)] += 1
        assert len(bounds) == 6 and max(counts) < 2 * 20_000 / 7
    if n == 5_000:
        assert len(bounds) > 2_500


def test_bounds_of_nothing(spark):
    empty = spark.createDataFrame([], "x long")
    assert range_bounds(empty, "x", 5) == [] and range_bounds(spark.createDataFrame([(None,)], "x long"), "x", 5) == []


def test_stretches_hold_a_hot_id(spark):
    rows = [(k, 10) for k in range(1_000)] + [(500, 10)] * 3_000 + [(None, 10)] * 2_000
    bounds, parts = huffman.stretches(spark.createDataFrame(rows, "doc_id long, n long"), 60_000, 12)
    assert list(bounds) == sorted(bounds) and parts.sum() >= 12 and parts.max() >= 6


def test_ranks_in_a_hot_key(spark):
    rows = [("hot", k * 7919 % 4_001) for k in range(4_001)] + [("b", 1), ("c", None), ("c", 3)]
    got = ranked(spark.createDataFrame(rows, "k string, v long").repartition(5), "k", ["v"], "test").collect()
    assert all(r["idx"] == r["v"] and r["n"] == 4_001 for r in got if r["k"] == "hot") and len(got) == len(rows)
    assert sorted((r["v"], r["idx"], r["n"]) for r in got if r["k"] == "c" and r["v"]) == [(3, 1, 2)]
