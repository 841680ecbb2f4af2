"""A Merkle manifest of a table: a ternary hash tree for each source, and one over the sources' roots.

Nodes are logged in the order in which they are complete (postorder). Node (level h, number j) is complete
with its last leaf t = min(n, (j + 1) 3^h) - 1; before it are the t leaves and floor(t / 3^l) nodes of each
level l, and the h nodes below it that t completes, too. So its position is

    position(h, t) = t + floor(t / 3) + floor(t / 9) + ... + h

which does not depend on n: what has been logged keeps its place when leaves are appended.

1. Leaves are hashed where their rows are read; from then on only digests and doc_ids are moved. A leaf's
   number in its source comes from ranges of (source, doc_id) (``ranks``).
2. Builders take aligned blocks of 3^LEVELS leaves each, hash the levels inside and log them; the blocks'
   tops are the leaves of the next round. Ten billion leaves need four rounds.
3. Proofs are extracted from the top down: a block's slice of the log holds all siblings below its top, at
   positions known in closed form; what lies above comes with one row for each block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.llm.common import written
from casefile.llm.ranks import ranked

ARITY, LEVELS = 3, 7
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
LOG = "tree string, block long, position long, level int, idx long, n long, digest binary, doc_id long, changed binary"
ABOVE = "tree string, block long, lefts array<string>, rights array<string>, subroot string, root string"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, tampered boolean, source string, leaf_index long"
_LOG = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("position", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("changed", pa.binary())])
_ABOVE = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])
_RESULT = pa.schema([(c, pa.string()) if t == "string" else (c, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for c, t in (x.split() for x in RESULT.split(", "))])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n of them."""
    h = 0
    while ARITY**h < n:
        h += 1
    return h


def position(level: np.ndarray | int, last: np.ndarray) -> np.ndarray:
    """The place in the log of nodes of ``level`` whose last leaves are ``last``."""
    out, above = last + level, last // ARITY
    while above.any():
        out, above = out + above, above // ARITY
    return out


def last_leaf(level: int, number: np.ndarray, n: int) -> np.ndarray:
    return np.minimum(n, (number + 1) * ARITY**level) - 1


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, digest and changed: the leaf of each row, and what it is after tampering, if that is
    something else. Nothing but these digests leaves the scan."""
    row = [F.col(f"`{c}`") for c in COLUMNS]
    text = F.when(F.crc32(row[0].cast("string")) % 2 == 0, F.translate(row[4].cast("string"), "\n", "")).otherwise(row[4].cast("string"))
    leaf = F.sha2(F.concat(*[_field(c) for c in row]), 256)
    changed = F.sha2(F.concat(*[_field(c) for c in row[:4]], _field(text)), 256)
    tree = F.coalesce(F.concat(F.lit("1"), row[1].cast("string")), F.lit("0")).alias("tree")
    return docs.select(tree, row[0].cast("long").alias("doc_id"), leaf.alias("leaf"), changed.alias("other")).select("tree", "doc_id", F.unhex("leaf").alias("digest"), F.when(F.col("leaf") != F.col("other"), F.unhex("other")).alias("changed"))


def _builder(base: int, levels: int):
    """What logs the nodes above one block's lowest nodes, which are of level ``base``."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        tree, block, n = table.column("tree")[0].as_py(), table.column("block")[0].as_py(), table.column("n")[0].as_py()
        first, below = table.column("idx")[0].as_py(), [d.hex() for d in table.column("digest").to_pylist()]
        level, made = base, []
        for level in range(base + 1, min(base + levels, height(n)) + 1):
            below = [digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)]
            first //= ARITY
            number = np.arange(first, first + len(below))
            made += zip(position(level, last_leaf(level, number, n)).tolist(), [level] * len(below), number.tolist(), below)
        made.sort()
        size = len(made)
        at, heights, numbers, digests = zip(*made) if made else ((), (), (), ())
        return pa.table([[tree] * size, [block] * size, at, heights, numbers, [n] * size, [bytes.fromhex(d) for d in digests], [None] * size, [None] * size], schema=_LOG)

    return build


def grown(numbered: DataFrame, name: str, levels: int = LEVELS) -> list[DataFrame]:
    """The log of trees whose leaves are ``numbered`` (tree, idx, n, digest, doc_id, changed), by rounds: each
    with its blocks' lowest nodes and what is above these, up to ``levels`` levels."""
    place = F.expr("idx + " + " + ".join(f"idx div {ARITY**k}" for k in range(1, 40)))
    low = written(numbered.select("tree", F.expr(f"idx div {ARITY**levels}").alias("block"), place.alias("position"), F.lit(0).alias("level"), "idx", "n", "digest", "doc_id", "changed"), f"{name}-leaves")
    most = low.agg(F.max("n")).first()[0] or 0
    rounds, base = [], 0
    while True:
        above = written(low.groupBy("tree", "block").applyInArrow(_builder(base, levels), LOG), f"{name}-log")
        rounds.append(low.unionByName(above))
        base += levels
        if ARITY**base >= most:
            return rounds
        tops = above.filter((F.col("level") == base) & (F.col("n") > ARITY**base))
        low = tops.withColumn("block", F.expr(f"idx div {ARITY**levels}"))


class Slice:
    """One block's nodes, found by their positions."""

    def __init__(self, table: pa.Table, base: int, levels: int):
        table = table.sort_by("position")
        self.base, self.n = base, table.column("n")[0].as_py()
        self.at = table.column("position").to_numpy()
        self.digests = [d.hex() for d in table.column("digest").to_pylist()]
        self.top = min(base + levels, height(self.n))
        self.lowest = np.flatnonzero(table.column("level").to_numpy() == base)
        self.numbers = table.column("idx").to_numpy()[self.lowest]
        self.table = table

    def find(self, level: int, number: np.ndarray) -> list[str]:
        return [self.digests[i] for i in np.searchsorted(self.at, position(level, last_leaf(level, number, self.n))).tolist()]

    def paths(self, above: tuple) -> list[tuple]:
        """For each of the lowest nodes its steps up to the root, as ((left, right), next steps): the siblings
        before and after it in its run."""
        below, first = [above], int(self.numbers[0]) // ARITY ** (self.top - self.base)
        for level in range(self.top - 1, self.base - 1, -1):
            low = int(self.numbers[0]) // ARITY ** (level - self.base)
            nodes = self.find(level, np.arange(low, int(self.numbers[-1]) // ARITY ** (level - self.base) + 1))
            steps = []
            for k in range(len(nodes)):
                run = (low + k) // ARITY
                begin = max(run * ARITY - low, 0)
                steps.append((("".join(nodes[begin:k]), "".join(nodes[k + 1 : begin + ARITY])), below[run - first]))
            below, first = steps, low
        return below


def _steps(above: pa.Table) -> tuple:
    path: tuple = ()
    for step in reversed(list(zip(above.column("lefts")[0].as_py(), above.column("rights")[0].as_py()))):
        path = (step, path)
    return path


def _flat(path: tuple) -> list[tuple[str, str]]:
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return out


def folded(leaf: str, steps: list[tuple[str, str]]) -> str:
    for left, right in steps:
        leaf = digest(left + leaf + right)
    return leaf


def _extractor(base: int, levels: int):
    """The steps from each of a block's lowest nodes to the root; a node is a block of the round below."""

    def extract(nodes: pa.Table, above: pa.Table) -> pa.Table:
        part = Slice(nodes, base, levels)
        paths = [_flat(p) for p in part.paths(_steps(above))]
        size = len(paths)
        subroot, root = above.column("subroot")[0].as_py(), above.column("root")[0].as_py()
        return pa.table([[nodes.column("tree")[0].as_py()] * size, part.numbers, [[a for a, _ in p] for p in paths], [[b for _, b in p] for p in paths], [subroot] * size, [root] * size], schema=_ABOVE)

    return extract


def _prover(levels: int):
    """The result's rows of one block of leaves."""

    def prove(nodes: pa.Table, above: pa.Table) -> pa.Table:
        part = Slice(nodes, 0, levels)
        subroot, root = above.column("subroot")[0].as_py(), above.column("root")[0].as_py()
        tree = nodes.column("tree")[0].as_py()
        low = part.table.take(pa.array(part.lowest))
        out = []
        for doc_id, leaf, changed, number, path in zip(low.column("doc_id").to_pylist(), low.column("digest").to_pylist(), low.column("changed").to_pylist(), part.numbers.tolist(), part.paths(_steps(above))):
            steps = _flat(path)
            top = folded((changed or leaf).hex(), steps)
            out.append((doc_id, leaf.hex(), subroot, root, digest("".join(a + b for a, b in steps)), top, top == root, changed is not None, tree[1:] if tree[0] == "1" else None, number))
        return pa.table([list(c) for c in zip(*out)], schema=_RESULT)

    return prove


def _joined(nodes: DataFrame, above: DataFrame, f, schema: str) -> DataFrame:
    return nodes.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(f, schema)


def steps_down(rounds: list[DataFrame], tops: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The steps above each block of leaves (tree, block, lefts, rights, subroot, root). ``tops`` has a tree's steps
    above its own root; it belongs to the round in which the tree has one block."""
    one = lambda k: F.col("n") <= ARITY ** (levels * (k + 1))
    above = None
    for k in range(len(rounds) - 1, -1, -1):
        here = tops.filter(one(k) if k == 0 else one(k) & ~one(k - 1)).select("tree", F.lit(0).cast("long").alias("block"), "lefts", "rights", "subroot", "root")
        above = here if above is None else here.unionByName(above)
        if k:
            above = written(_joined(rounds[k], above, _extractor(k * levels, levels), ABOVE), "above")
    return above


def roots(rounds: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """tree, n and the digest of its root."""
    found = None
    for k, nodes in enumerate(rounds):
        sizes = F.array([F.lit(ARITY**h).cast("long") for h in range(40)])
        tall = F.size(F.filter(sizes, lambda x: x < F.col("n")))
        top = nodes.filter((F.col("level") == tall) & ((F.col("level") > k * levels) | F.lit(k == 0))).select("tree", "n", "digest")
        found = top if found is None else found.unionByName(top)
    return found


def merkle_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and what the root becomes if its text is tampered with.

    ``docs`` has doc_id, source, lang, n_chars and text; other columns take no part. Nulls are hashed as ``-``, texts
    whole. Leaves with one doc_id, or none, are in the order of their digests (a null doc_id comes first, and is not
    tampered with); equal rows are leaves of their own, each with its own proof. A null source is a
    source, the first; an empty one is another. A lone leaf is its source's root, a lone source's root is the root,
    and without siblings the proof is the hash of the empty text. An empty table has no rows and no root."""
    hashed = written(leaves(docs), "leaves")
    rounds = grown(ranked(hashed, "tree", ["doc_id", "digest"], "ranked"), "merkle", levels)
    subroots = written(roots(rounds, levels), "subroots")
    whole = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("n").alias("leaves"), "digest")
    numbered = written(ranked(whole, "tree", ["source"], "sources"), "numbered")
    over = grown(numbered.select("tree", "idx", "n", "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("changed")), "top", levels)
    none = F.array().cast("array<string>")
    root = roots(over, levels).select("tree", "n", none.alias("lefts"), none.alias("rights"), F.lower(F.hex("digest")).alias("root")).withColumn("subroot", F.col("root"))
    sides = written(_joined(over[0], steps_down(over, root, levels), _extractor(0, levels), ABOVE), "sides")
    named = numbered.select(F.col("idx").alias("block"), "source", "leaves", F.lower(F.hex("digest")).alias("own"))
    tops = written(sides.join(named, "block").select(F.col("source").alias("tree"), F.col("leaves").alias("n"), "lefts", "rights", F.col("own").alias("subroot"), "root"), "tops")
    return _joined(rounds[0], steps_down(rounds, tops, levels), _prover(levels), RESULT)

