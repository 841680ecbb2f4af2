"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from casefile.llm import near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_force(rows):
    """The row with the smallest doc_id (null last) of each component, with whether any pair is at
    0.8 or more and whether any is a little less."""
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    near = below = 0
    for i in range(len(rows)):
        for j in range(i):
            s = similarity(sets[i], sets[j])
            near += 0.8 <= s < 1
            below += 0.55 <= s < 0.8
            if s >= 0.8 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for r, g in zip(rows, group):
        key = (r[0] is None, r[0] or 0)
        if g not in least or key < least[g][0]:
            least[g] = (key, r)
    return sorted(repr(r) for _, r in least.values()), near, below


def test_exact_components(spark):
    rnd = random.Random(5)
    texts = []
    for _ in range(40):
        base = [rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randrange(400)) for _ in range(rnd.randrange(60, 300))]
        texts.append(" ".join(base))
        for share in (0.01, 0.02, 0.03, 0.05, 0.08):
            changed = [f"new{rnd.random()}" if rnd.random() < share else w for w in base]
            texts.append(" ".join(changed))
    chain = [f"w{i}" for i in range(400)]
    texts += [" ".join(chain[k : k + 200]) for k in range(0, 200, 10)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    rnd.shuffle(rows)
    want, near, below = brute_force(rows)
    assert near > 50 and below > 50
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(repr(tuple(r)) for r in got) == want


def test_rows_without_or_with_equal_doc_ids_stay(spark):
    rows = [(None, "one two three four five six seven", "en", "s", 33), (None, "red green blue black white pink", "en", "s", 31), (7, "alpha beta gamma delta", "en", "s", 22), (7, "north south east west up", "en", "s", 24), (8, "ALPHA beta  gamma delta", "en", "s", 23), (9, "", "en", "s", 0)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame([*rows, rows[0]], SCHEMA), "").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(r) for r in rows if r[0] != 8)
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


@pytest.mark.parametrize("cell", [near_duplicates.CELL, 20_000])
def test_large_group_of_near_copies(spark, monkeypatch, cell):
    """Variants of one text, of which many are near enough to few others only; with small cells a
    bucket is dealt to a grid."""
    monkeypatch.setattr(near_duplicates, "CELL", cell)
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(f"x{rnd.random()}" if rnd.random() < share else w for w in base) for share in (0.005, 0.015, 0.02, 0.03) for _ in range(90)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    want, near, below = brute_force(rows)
    assert near > 1000 and below > 1000 and 10 < len(want) < 300
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(repr(tuple(r)) for r in got) == want


def test_joining_inside_a_bucket():
    rnd = np.random.default_rng(7)
    for _ in range(50):
        sets = [np.unique(rnd.integers(0, 30, rnd.integers(1, 25))).astype(np.int64) for _ in range(20)]
        nodes = [bytes([k]) for k in range(20)]
        parts = [bytes([100 + int(x)]) for x in rnd.integers(0, 12, 20)]
        links = near_duplicates.joining(nodes, parts, np.zeros(20, int), sets, 60)

        def components(pairs):
            of = {n: p for n, p in zip(nodes, parts)}
            for a, b in pairs:
                x, y = of[a], of[b]
                of = {n: (x if p == y else p) for n, p in of.items()}
            return sorted(sorted(n for n in nodes if of[n] == p) for p in set(of.values()))

        near = [(nodes[i], nodes[j]) for i in range(20) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))]
        assert components(links) == components(near) and set(links) <= {(b, a) for a, b in near} | set(near)
        assert len(links) < 20
