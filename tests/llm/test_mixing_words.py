"""Every source of a mixture takes its target's words, however small it is."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from casefile.llm import mixing


@pytest.mark.parametrize("n", [1, 2, 17, 300, 4096])
def test_permutation_is_undone(n):
    at = np.arange(n)
    assert (mixing.permuted(mixing.permuted(at, n, 99), n, 99, back=True) == at).all()


@pytest.mark.parametrize("block", [64, corpus_pipeline.MIX_BLOCK])
def test_small_sources_take_their_targets(spark, block):
    sizes = {"big": 30_000, "big2": 21_013, "mid": 700, **{f"s{k:02}": 1 + 7 * k for k in range(20)}}
    rows = []
    for source, n in sizes.items():
        while n:
            size = min(n, 90)
            rows.append((len(rows), " ".join(["w"] * size), source, 2 * size - 1))
            n -= size
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got, want = collections.Counter(), {}
    for r in mixing.mix_digest(docs, block=block).collect():
        got[r["source_size"]] += r["taken"]
        want[r["source_size"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(got[k] - want[k]) <= 1 and got[k] for k in sizes.values())
    words = collections.Counter()
    for r in mixing.mix_texts(docs, block=block).collect():
        words[sizes[r["source"]]] += len(r["text"].split())
    assert words == got


def brute_mix(rows, seed, block):
    """taken of each row, by building every block and drawing every slot one by one."""
    order = sorted({r[2] for r in rows if r[2] is not None}) + [None] * any(r[2] is None for r in rows)
    size = {s: sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in order}
    target, taken = mixing.targets(size), collections.Counter()
    for s in order:
        mine = sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, len((rows[k][1] or "").split())))
        flat = [k for k in mine for _ in (rows[k][1] or "").split()]
        step = min(block, max(size[s] // mixing.PARTS, mixing.LEAST))
        blocks = [flat[a : a + step] for a in range(0, len(flat), step)]
        left, epoch = min(max(1, round(target[s])), 3 * size[s]) if target[s] > 0 else 0, 0
        while left:
            at = mixing.permuted(np.arange(len(blocks)), len(blocks), mixing.key_of(seed, s, epoch))
            for b in at.tolist():
                got = blocks[b][:left]
                taken.update(got)
                left -= len(got)
            epoch += 1
    return [taken[k] for k in range(len(rows))]


def test_taken_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 5)
    rows = [(k if k % 19 else None, " ".join(f"w{k}" for _ in range(k * 7 % 61)) or None, ("a", "b", "ü", None, "tiny")[min(k % 5, 3 + (k % 35 == 0))] if k != 77 else "tiny") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(repr((r["doc_id"], r["size"], r["taken"])) for r in mixing.mix_digest(docs, seed=4, block=16).collect())
    want = brute_mix(rows, 4, 16)
    assert got == sorted(repr((r[0], len((r[1] or "").split()), n)) for r, n in zip(rows, want))


def test_equal_rows_lose_no_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(5, "one", "a")] * 101 + [(None, "one two", "b")] * 30 + [(None, "three", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, target, size = collections.Counter(), {}, collections.Counter()
    for r in mixing.mix_digest(docs).collect():
        got[r["source_size"]] += r["taken"]
        target[r["source_size"]], size[r["source_size"]] = r["target"], size[r["source_size"]] + 1
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(got[k] - target[k]) <= 1 for k in target) and size == {101: 101, 61: 31}
    both = spark.createDataFrame([(1, "a b c", "s", "en"), (1, "d e f", "s", "en"), (None, "g h", "s", "fr"), (None, "i", "s", "fr")], "doc_id long, text string, source string, lang string")
    assert sorted(r["text"] for r in mixing.mix_texts(both).collect()) == ["a b c", "d e f", "g h", "i"]


def test_shards_are_drawn_alone():
    slots = np.array([1000, 17, 4, 0, 300])
    before = np.zeros(5, int)
    for k in range(14):
        counts, begin = mixing.drawn_counts(slots, k, 14, 100, 9)
        assert (begin == before).all() and counts.sum() == (100 if k < 13 else 21)
        before += counts
    assert (before == slots).all()
