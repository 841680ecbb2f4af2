"""Near-duplicates: candidates of SimHash anchors and of MinHash keys, verified by whole shingle sets.

1. Texts with the same set of shingles become one node. Candidates are (a) pairs whose SimHash
   fingerprints differ in 2 bits or fewer (``simhash.links``), (b) nodes that share one of BANDS keys
   of ROWS MinHash values each. At a similarity of 0.8 a bit of a fingerprint differs with a
   probability of 0.15, so that no number of anchors that could be stored finds such pairs; they
   share no key with a probability of (1 - 0.8^5)^24 < 0.0001.
2. Pairs of (a), and each node with one node of each of its buckets (another one for each band), are
   compared by their whole sets: the links of a large group of copies stay in proportion to its size.
3. Buckets whose nodes are still in different components are compared inside tasks, all nodes with
   those outside the bucket's largest component; a bucket of over CELL bytes is dealt to a grid of
   cells. Only links that join components leave a task. Hence the components are those of all
   candidates of enough similarity, and no pairs of a group are ever listed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.llm import simhash
from casefile.llm.common import lean, pieces, plain, with_row, words_of, written
from casefile.llm.components import connected_components
from casefile.llm.simhash import LOWER, SEED

BANDS, ROWS = 24, 5
#: Bytes of sets in a block of a large bucket.
CELL = 4 << 20
CHUNK = 2_048
_random = np.random.default_rng(SEED)
FACTOR = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
TERM = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
SKETCH = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("node", pa.binary()), ("fingerprint", pa.binary()), ("bands", pa.list_(pa.int64()))])
LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])
SETS = pa.schema([("node", pa.binary()), ("set", pa.list_(pa.int64()))])


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z are lower-cased, and fewer words than
    ``shingle`` make one shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    whole, n = b" ".join(words).translate(LOWER), max(1, len(words) - shingle + 1)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(length) - length
    end = (start + length - 1)[-n:].tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in zip(start.tolist(), end)], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        mixed = FACTOR[:, None] * hashes[None, at : at + CHUNK] + TERM[:, None]
        np.minimum(least, mixed.min(1), out=least)
    data, n = least.tobytes(), 8 * ROWS
    return [xxhash.xxh64_intdigest(data[k * n : (k + 1) * n], k) - (1 << 63) for k in range(BANDS)]


def fingerprint_of(hashes: np.ndarray) -> bytes:
    """SimHash of a set: a bit is 1 if over half of the hashes have it."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        count += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(hashes)).tobytes()


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = [shingle_set(t.as_py(), shingle) for t in part.column("text")]
                nodes = [hashlib.md5(s.tobytes(), usedforsecurity=False).digest() for s in sets]
                prints = [fingerprint_of(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("_row").cast(pa.string()), part.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(prints, pa.binary()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))], schema=SKETCH)

    return docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "row string, doc_id long, node binary, fingerprint binary, bands array<long>")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node and set of texts (node, text)."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], schema=SETS)

    return texts.select("node", "text").mapInArrow(lean(run), "node binary, set array<long>")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard similarity of ``percent`` or more."""
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    both = x.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("n"))
    return both.filter(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def _pairs(x: DataFrame, p: str, q: str) -> DataFrame:
    return x.filter(F.col(p) != F.col(q)).select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")).distinct()


def joining(nodes: list[bytes], parts: list[bytes], blocks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links of enough similarity between nodes of different parts: enough of them to join what all
    of them join. Of two blocks, only nodes of different ones are compared."""
    names = {x: k for k, x in enumerate(dict.fromkeys(parts))}
    group = np.array([names[x] for x in parts])
    largest = np.bincount(group).argmax()
    size = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    new = np.append(True, np.diff(flat[order]) != 0)
    begin = np.flatnonzero(new)
    n = np.diff(begin, append=len(flat))
    shingle = np.empty(len(flat), np.int64)
    shingle[order] = np.cumsum(new) - 1
    holds, at, out = owner[order], np.append(0, np.cumsum(size)), []
    two = blocks.min() != blocks.max()
    for i in np.flatnonzero(group != largest).tolist():
        mine = shingle[at[i] : at[i + 1]]
        mine = mine[n[mine] > 1]
        if not len(mine):
            continue
        k = n[mine]
        both = np.bincount(holds[np.repeat(begin[mine] - np.cumsum(k) + k, k) + np.arange(k.sum())], minlength=len(sets))
        near = (100 * both >= percent * (size + size[i] - both)) & (group != group[i])
        if two:
            near &= blocks != blocks[i]
        for j in np.flatnonzero(near).tolist():
            if group[j] != group[i]:
                out.append((nodes[i], nodes[j]))
                group[group == group[i]] = group[j]
    return out


def joined_inside(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the parts of each bucket of ``placed`` (bucket, node, part)."""
    held = placed.join(sets, "node")
    bytes_ = held.groupBy("bucket").agg(F.sum(F.size("set").cast("long") * 8).alias("bytes")).select("bucket", F.ceil(F.col("bytes") / CELL).alias("cells"))
    held = held.join(bytes_, "bucket")
    own, cells = F.pmod(F.xxhash64("node"), F.col("cells")), F.col("cells")
    of = F.transform(F.sequence(F.lit(0).cast("long"), cells - 1), lambda q: F.least(own, q) * cells + F.greatest(own, q))
    dealt = held.select("bucket", F.explode(of).alias("cell"), own.alias("block"), "node", "part", "set")

    def run(batches):
        key, rows = None, []

        def found():
            if len({r[1] for r in rows}) < 2:
                return
            links = joining([r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows]), [r[3] for r in rows], percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*links)], schema=LINK)

        for batch in batches:
            offsets, flat = batch.column("set").offsets.to_numpy(), batch.column("set").values.to_numpy()
            for k, (bucket, cell, block, node, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "cell", "block", "node", "part")))):
                if (bucket, cell) != key:
                    yield from found()
                    key, rows = (bucket, cell), []
                rows.append((node, part, block, flat[offsets[k] : offsets[k + 1]]))
        yield from found()

    return dealt.repartition(F.col("bucket"), F.col("cell")).sortWithinPartitions("bucket", "cell").mapInArrow(lean(run), "a binary, b binary")


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Of each connected component of near-duplicates the row with the smallest doc_id (null last;
    of rows that share it, the one with the smallest row key).

    ``docs`` has doc_id and text; all its columns are kept. Null, empty and blank texts, which have
    no words, are copies of each other. Rows are told apart by all of their columns, so that a missing or a shared doc_id loses
    no text; equal rows are copies. Texts are compared whole, however long. An empty table gives an empty result. Other columns may have any names.
    """
    names, docs = docs.columns, plain(docs, ("doc_id", "text"))
    keyed = with_row(docs)
    sketch = written(sketches(keyed, shingle), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    nodes = written(sketch.groupBy("node").agg(first, F.first("fingerprint").alias("fingerprint"), F.first("bands").alias("bands")), "nodes")
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    met = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node", "bucket")).alias("one")).filter("n > 1")
    shared = written(buckets.join(met.select("bucket", "one"), "bucket"), "buckets")
    # Of the nodes with one fingerprint, each goes with the smallest; of two linked ones, their smallest.
    prints = nodes.filter(F.size("bands") > 0).groupBy("fingerprint").agg(F.min("node").alias("one"))
    close = simhash.links(prints)
    to = prints.withColumnsRenamed({"fingerprint": "_print", "one": "_one"})
    close = close.join(to, F.col("a") == F.col("_print")).select("b", F.col("_one").alias("node")).join(to, F.col("b") == F.col("_print")).select("node", F.col("_one").alias("one"))
    copies = nodes.join(prints, "fingerprint").select("node", "one")

    tried = written(_pairs(shared.select("node", "one").unionByName(close).unionByName(copies), "node", "one"), "tried")
    needed = tried.select(F.col("a").alias("node")).unionByName(tried.select(F.col("b").alias("node"))).unionByName(shared.select("node")).distinct()
    texts = keyed.select("_row", "text").join(nodes.join(needed, "node").select("node", F.col("first.row").alias("_row")), "_row").dropDuplicates(["_row"])
    sets = written(shingle_sets(texts, shingle), "sets")
    links = written(similar(tried, sets, percent), "links")
    parts = connected_components(links)
    placed = shared.join(parts, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part"))
    mixed = placed.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("bucket")
    more = written(joined_inside(placed.join(mixed, "bucket"), sets, percent), "links")
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more))
    kept = nodes.join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("part")).agg(F.min("first").alias("first"))
    return keyed.join(kept.select(F.col("first.row").alias("_row")), "_row").dropDuplicates(["_row"]).select(*docs.columns).toDF(*names)
