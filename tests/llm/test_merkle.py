"""The Merkle manifest against a brute-force one: several rounds of blocks, odd rows, tampering."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from casefile.llm.merkle import height, last_leaf, merkle_manifest, position

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, at):
    """The root of nodes, and the siblings of one of them by level."""
    steps = []
    while len(nodes) > 1:
        run = at // 3 * 3
        steps.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
        nodes, at = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], at // 3
    return nodes[0], steps


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in by:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subroots = [climb([leaf(r) for r in by[s]], 0)[0] for s in order]
    out = []
    for k, s in enumerate(order):
        nodes = [leaf(r) for r in by[s]]
        root, over = climb(subroots, k)
        for i, r in enumerate(by[s]):
            steps = climb(nodes, i)[1] + over
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            top = leaf((*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]))
            for a, b in steps:
                top = sha(a + top + b)
            out.append((str(r[0]), nodes[i], subroots[k], root, sha("".join(a + b for a, b in steps)), top, top == root))
    return sorted(out)


def run(df, **more):
    got = merkle_manifest(df, **more).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted((str(r[0]), *r[1:]) for r in got)


def many(n):
    pick = random.Random(n)
    rows = [(k, "big" if pick.random() < 0.6 else pick.choice(["é", "z", "", None, "A"]), pick.choice(["en", None]), pick.choice([None, k]), pick.choice(["a\nb", "line", "", None, "\n\n", "ü" * 30])) for k in range(n)]
    return rows + rows[:7] + [(None, "big", None, None, "x\ny"), (None, "big", None, None, None), (3, "big", "en", 1, "other"), (-5, "z", "en", 1, "a\nb"), (9, "alone", "en", 1, "w\n" * 50_000)]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_equals_brute_force(spark, levels):
    rows = many(90)
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(5), levels=levels) == brute(rows)


def test_small_tables(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    for rows in ([(1, None, None, None, None)], [(2, "a", "en", 3, "x\n")] * 3, [(k, f"s{k}", "en", 3, "x\n") for k in range(11)]):
        assert run(spark.createDataFrame(rows, SCHEMA), levels=1) == brute(rows)


def test_other_columns_take_no_part(spark):
    rows = many(20)
    df = spark.createDataFrame(rows, SCHEMA)
    more = df
    for c in ("tree", "idx", "n", "block", "digest", "a.b", "_at", "level"):
        more = more.withColumn(c, F.lit("x"))
    assert run(more) == run(df)


def test_only_tampering_with_a_newline_is_noticed(spark):
    got = merkle_manifest(spark.createDataFrame(many(60), SCHEMA)).collect()
    assert {r["verified"] for r in got if r["tampered"]} == {False} and {r["verified"] for r in got if not r["tampered"]} == {True}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 100])
def test_positions_are_the_order_of_completion(n):
    log, stack = [], []
    for t in range(n):
        done = [(0, t)]
        log.append((0, t))
        for h in range(1, height(n) + 1):
            if (t + 1) % 3**h == 0 or t == n - 1:
                done.append((h, t // 3**h))
                log.append((h, t // 3**h))
            else:
                break
        stack.append(done)
    for k, (h, j) in enumerate(log):
        import numpy as np

        assert position(h, last_leaf(h, np.array([j]), n))[0] == k
