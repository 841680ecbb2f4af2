"""The trie of conversations against a brute-force one: bands, many shards, copies, odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from casefile.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, role, sha(f"{len(role.encode())}:{role}{text}"), text))
    for turns in own.values():
        turns.sort()
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = abs(c) % 20 * (1 if c > 0 else -1)
        convs[c] = tuple((t[2], t[4]) for t in own.get(c - rest, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    words = lambda key: len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
    below = {}
    for key in sorted(nodes, key=len, reverse=True):
        kids = children.get(key, [])
        below[key] = (sum(below[k][0] for k in kids) if kids else 1, (len(nodes[key]) - 1) * words(key) + sum(below[k][1] for k in kids))
    out = []
    for key, members in nodes.items():
        ends = sorted(c for c in members if len(convs[c]) == len(key))
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), len(children.get(key, [])), *below[key], sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def run(df, **more):
    return sorted((tuple(r) for r in conversation_trie(df, **more).collect()), key=repr)


def talks(n, seed=0, longest=9):
    pick = random.Random(seed)
    rows = []
    for c in range(n):
        hot = pick.random() < 0.4
        for t in range(pick.randrange(1, longest)):
            text = f"word {t}" if hot and pick.random() < 0.9 else pick.choice(["a b", "a", "", None, "ü\tx y"])
            rows.append((c, t if pick.random() < 0.97 else None, pick.choice(["user", "user", None]) if not hot else "user", text))
    return rows


def odd():
    return [(None, 1, "user", "lost"), (1000, None, None, None), (-7, 1, "user", "a b"), (-7, 2, "user", "c"), (-41, 1, "user", "a b"), (5, 3, "user", "word 1"), (5, 3, "user", "word 1")]


@pytest.mark.parametrize(("width", "shard_rows"), [(1, 7), (2, 5), (3, 1_000), (16, 10)])
def test_equals_brute_force(spark, width, shard_rows):
    rows = talks(70, width) + odd()
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(6), width=width, shard_rows=shard_rows) == brute(rows)


def test_copies_over_many_shards_and_one_long_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(20, 140) for t in range(4)] + [(3, t, "user", f"x {t % 5}") for t in range(300)] + [(4, t, "user", f"x {t % 5}") for t in range(150)]
    assert run(spark.createDataFrame(rows, SCHEMA), width=4, shard_rows=10) == brute(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 1, "user", "gone") for c in range(21, 40)]
    got = run(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows) and any(r[1] == 0 and r[3] == 19 for r in got)
    alone = [(c, 1, "user", "gone") for c in range(21, 60) if zlib.crc32(str(c).encode()) % 4]
    alone = [r for r in alone if r[0] % 20]
    assert run(spark.createDataFrame(alone, SCHEMA)) == brute(alone)


def test_empty_tables_and_other_columns(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    assert run(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []
    rows = talks(12, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("idx", "n", "band", "first", "shard", "words", "id", "a.b"):
        df = df.withColumn(c, F.lit(1))
    assert run(df) == brute(rows)


def test_very_long_texts(spark):
    rows = [(20, 1, "user", "w " * 200_000), (40, 1, "user", "w " * 200_000), (40, 2, None, "v" * 300_000)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
