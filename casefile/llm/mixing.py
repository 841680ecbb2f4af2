"""Mixing sources to target weights by blocks of words.

1. The words of each source, in the order of doc_id, are packed into blocks of BLOCK words (fewer in
   small sources: see ``Plan``); a document's share of its blocks follows from a prefix sum, taken in
   two levels so that a source that holds most rows is not summed by one task.
2. Targets: see ``targets``. A source gets slots, at most three for a block, that hold its target's
   words: the last slot takes no more of its block than is wanting.
3. Output shards draw their counts of each source from the slots that are left (a multinomial draw
   without replacement, so the totals are exact). The draws depend on the seed only.
4. Slot j of a source reads block p_e(j mod n) of epoch e = j div n, where p_e is a pseudorandom
   permutation of 0..n-1 (a Feistel network with cycle walking): each epoch takes each block at most
   once. Slots and blocks are joined by source and index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.llm.common import pieces, plain, with_row, written
from casefile.llm.ranks import range_bounds

#: Columns that are read; others only tell rows apart, whatever their names.
KNOWN = ("doc_id", "text", "source", "n_chars")

BLOCK = 64
#: A source has so many blocks at least, unless these would have under LEAST words.
PARTS, LEAST = 16, 16
SHARD_BLOCKS = 8_192
MOST = 3
#: Copies of a row that are dealt out together.
COPIES = 100_000
#: The prefix sum has so many bins of documents; beyond BIN_ROWS documents a bin, more bins.
BINS, BIN_ROWS = 256, 20_000
SIZES = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64())])
SIZES_DDL = "row string, doc_id long, source string, size long"


def sizes(docs: DataFrame) -> DataFrame:
    """row, doc_id, source and size: the words of each whole text (null: 0). ``row`` tells a row from
    all that differ in any column."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                n = [len(t.as_buffer().to_pybytes().split()) if t.is_valid and len(t.as_buffer() or b"") else 0 for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("_row").cast(pa.string()), part.column("doc_id"), part.column("source"), pa.array(n, pa.int64())], schema=SIZES)

    return with_row(docs).select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(run, SIZES_DDL)


def weight_of(rank: int) -> int:
    return 1 + rank % 3


def targets(size: dict[str | None, int]) -> dict[str | None, float]:
    """Shares of all words: sources by code point, null last, weigh 1, 2, 3, repeating; a target
    stops at MOST times its source's size, and what is over is shared again by weight."""
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in size if s is None]
    weight = {s: weight_of(k) for k, s in enumerate(order)}
    open_, left, out = set(order), float(sum(size.values())), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in order if s in open_ and left * weight[s] / total > MOST * size[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in order if s in open_}
        for s in full:
            out[s] = float(MOST * size[s])
            open_.remove(s)
        left = float(sum(size.values())) - sum(out.values())
    return out


def key_of(seed: int, source: str | None, *more: int) -> int:
    text = f"{seed}|{'n' if source is None else 's' + source}|{'|'.join(map(str, more))}"
    return int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8], "big")


def _half(n: int) -> int:
    return max(1, ((n - 1).bit_length() + 1) // 2)


def _round(b: np.ndarray, key: int, r: int) -> np.ndarray:
    f = (b + np.uint64((key >> 8 * r ^ 0x9E3779B97F4A7C15 * (r + 1)) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    f ^= f >> np.uint64(32)
    f *= np.uint64(0xD6E8FEB86659FD93)
    return f >> np.uint64(40)


def permuted(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """p(index) of a pseudorandom permutation of 0..n-1; with ``back`` what p takes to index."""
    half = _half(n)
    low = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & low
        for r in range(6):
            a, b = b, a ^ (_round(b, key, r) & low)
        return a << np.uint64(half) | b

    def undone(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & low
        for r in reversed(range(6)):
            a, b = b ^ (_round(a, key, r) & low), a
        return a << np.uint64(half) | b

    step = undone if back else once
    x = step(index.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = step(x[out])
    return x.astype(np.int64)


def drawn_counts(slots: np.ndarray, shard: int, shards: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """How many slots of each source an output shard takes, and how many the shards before it take.

    Slots are dealt down a binary tree of shards: at each node the left half's are drawn, multinomially
    by what the node has of each source (what a source does not have is drawn anew from the others),
    by a seed of the node's own. So every shard's counts follow from its number alone, each shard has
    ``size`` slots but for the last, and the totals are exact."""
    have, before, low, high = slots.astype(np.int64), np.zeros(len(slots), np.int64), 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        random = np.random.default_rng([seed, low, high])
        got, want = np.zeros(len(have), np.int64), size * (middle - low)
        while (short := want - int(got.sum())) > 0:
            rest = have - got
            got = np.minimum(got + random.multinomial(short, rest / rest.sum()), have)
        if shard < middle:
            have, high = got, middle
        else:
            have, before, low = have - got, before + got, middle
    return have, before


def draws(slots: dict[str | None, int], seed: int, shard_blocks: int = SHARD_BLOCKS) -> list[list[int]]:
    """For each output shard its counts of the sources (in the order of ``slots``)."""
    all_ = np.array(list(slots.values()), np.int64)
    shards = -(-int(all_.sum()) // shard_blocks)
    return [drawn_counts(all_, k, shards, shard_blocks, seed)[0].tolist() for k in range(shards)]


def positions(sized: DataFrame, rows: int) -> DataFrame:
    """``sized`` with start: the words of the same source before the document (doc_id order; nulls
    first; equal doc_ids by size, then row). Bins of doc_ids are summed first, then documents within bins."""
    bins = max(1, min(max(BINS, -(-rows // BIN_ROWS)), rows // 16))
    bounds = range_bounds(sized, "doc_id", bins) if bins > 1 else []
    spark = sized.sparkSession
    shared = spark.sparkContext.broadcast(np.array(bounds))
    schema = pa.schema([*SIZES, ("bin", pa.int64())])

    def bin_(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(shared.value, ids, side="right"))], schema=schema)

    binned = sized.mapInArrow(bin_, SIZES_DDL + ", bin long")
    sums = binned.groupBy("source", "bin").agg(F.sum("size").alias("t"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "bin", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bin").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = binned.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.alias("p").join(base.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.bin") == F.col("b.bin")))
    return joined.select("p.row", "p.doc_id", "p.source", "p.size", (F.col("b.base") + F.col("p.within")).alias("start"))


class Plan:
    """The mixture of ``sized`` (doc_id, source, size): targets, slots and blocks. A source's blocks
    hold ``block`` words, or a PARTS-th of its words if that is less, but not under LEAST. A source with a
    positive target takes one word at least. Sources are a catalogue: one row for each reaches the driver."""

    def __init__(self, sized: DataFrame, seed: int = 0, block: int = BLOCK):
        self.sized, self.seed, self.block = sized, seed, block
        found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        self.size = {r["source"]: r["size"] for r in sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))}
        self.rows = sum(r["n"] for r in found)
        self.target = targets(self.size)
        self.step = {s: min(block, max(n // PARTS, LEAST)) for s, n in self.size.items()}
        self.blocks = {s: -(-n // self.step[s]) for s, n in self.size.items()}
        self.wanted = {s: min(max(1, round(t)), MOST * self.size[s]) if t > 0 else 0 for s, t in self.target.items()}
        filled = {s: self._filled(s) for s in self.size}
        self.slots = {s: n for s, (n, _) in filled.items()}
        self.cut = {s: n for s, (_, n) in filled.items()}

    def _filled(self, source: str | None) -> tuple[int, int]:
        """The slots that hold the words wanted of a source, and the words that the last of them takes."""
        step, blocks = self.step[source], self.blocks[source]
        if not self.wanted[source]:
            return 0, step
        epoch, rest = divmod(self.wanted[source], self.size[source])
        if not rest:
            return epoch * blocks, step
        # The epoch that is begun meets the source's last block, which may be short, at slot ``short``.
        short = int(permuted(np.array([blocks - 1]), blocks, key_of(self.seed, source, epoch), back=True)[0])
        held = lambda n: n * step - (blocks * step - self.size[source] if short < n else 0)
        n = -(-rest // step)
        n += held(n) < rest
        return epoch * blocks + n, rest - held(n - 1)

    def catalogue(self) -> DataFrame:
        spark = self.sized.sparkSession
        data = [(s, n, float(self.target[s]), self.step[s]) for s, n in self.size.items()]
        return spark.createDataFrame(data, "source string, source_size long, target double, step long")

    def drawn(self) -> DataFrame:
        """shard, slot, source, epoch, block and most (words): what each output shard reads, in its
        order. A task draws its own shards' counts."""
        order = list(self.slots)
        all_ = np.array([self.slots[s] for s in order], np.int64)
        shards = max(1, -(-int(all_.sum()) // SHARD_BLOCKS))
        blocks, seed, step, last = self.blocks, self.seed, self.step, self.cut
        schema = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("source", pa.string()), ("epoch", pa.int64()), ("block", pa.int64()), ("most", pa.int64())])

        def read(batches):
            for batch in batches:
                for shard in batch.column("shard").to_pylist():
                    counts, before = drawn_counts(all_, shard, shards, SHARD_BLOCKS, seed)
                    for i in np.flatnonzero(counts).tolist():
                        source, begin, end = order[i], int(before[i]), int(before[i] + counts[i])
                        for k in range(begin, end, 1 << 16):
                            j = np.arange(k, min(k + (1 << 16), end))
                            epoch, at = np.divmod(j, blocks[source])
                            block = np.empty(len(j), np.int64)
                            for e in np.unique(epoch):
                                block[epoch == e] = permuted(at[epoch == e], blocks[source], key_of(seed, source, int(e)))
                            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(j), pa.int64()), pa.array(j), pa.array([source] * len(j), pa.string()), pa.array(epoch), pa.array(block), pa.array(np.where(j == all_[i] - 1, last[source], step[source]))], schema=schema)

        numbers = self.sized.sparkSession.range(0, shards, 1, min(shards, 4096)).select(F.col("id").alias("shard"))
        return numbers.mapInArrow(read, "shard long, slot long, source string, epoch long, block long, most long")

    def packed(self) -> DataFrame:
        """source, block, row, doc_id, size, at, first and n: the words [first, first + n) of a document,
        which a block holds from its word ``at`` on."""
        placed = _with_targets(positions(self.sized, self.rows).filter("size > 0"), self)
        b, start, size = F.col("step"), F.col("start"), F.col("size")
        parts = placed.withColumn("block", F.explode(F.sequence(F.expr("start div step"), F.expr("(start + size - 1) div step"))))
        begin = F.greatest(F.col("block") * b, start)
        end = F.least((F.col("block") + 1) * b, start + size)
        return parts.select("source", "block", "row", "doc_id", "size", (begin - F.col("block") * b).alias("at"), (begin - start).alias("first"), (end - begin).alias("n"))

    def mixed(self) -> DataFrame:
        """The mixture: shard, slot, source, epoch, row, doc_id, size, first, n."""
        # Slots come from few rows, so Spark would take them for few and broadcast them.
        a, b = self.drawn().hint("merge").alias("a"), self.packed().hint("merge").alias("b")
        on = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.block") == F.col("b.block"))
        n = F.least("b.n", F.col("a.most") - F.col("b.at")).alias("n")
        return a.join(b, on).filter("b.at < a.most").select("a.shard", "a.slot", "a.source", "a.epoch", "b.row", "b.doc_id", "b.size", "b.first", n)


def mix_digest(docs: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document.

    ``docs`` has doc_id, text and source; other columns only tell rows apart. A null source is a source
    of its own, the last. Documents without words take no part in blocks and have taken 0. Null or
    shared doc_ids are documents of their own; rows equal in all columns share what they take evenly,
    the rest going to any of them. Texts are counted whole. An empty table, or one without words, takes nothing.
    """
    sized = written(sizes(plain(docs, KNOWN)), "sizes")
    plan = Plan(sized, seed, block)
    taken = plan.mixed().groupBy("row").agg(F.sum("n").alias("taken"))
    alike = sized.groupBy("row").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("doc_id", "source", "size")])
    shares = written(alike.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0))), "shares")
    # A row that occurs very often is dealt out in stretches of its copies.
    chunks = F.expr(f"explode(sequence(0L, (copies - 1) div {COPIES}))").alias("chunk")
    often = shares.filter(f"copies > {COPIES}").select("*", chunks).repartition("row", "chunk")
    each = shares.filter(f"copies <= {COPIES}").withColumn("chunk", F.lit(0).cast("long")).unionByName(often)
    each = each.withColumn("k", F.expr(f"explode(sequence(chunk * {COPIES}, least(copies, (chunk + 1) * {COPIES}) - 1))"))
    out = each.select("doc_id", "source", "size", F.expr("taken div copies + int(k < taken % copies)").alias("taken"))
    return _with_targets(out, plan).select("doc_id", "size", "source_size", "target", "taken")


def _with_targets(out: DataFrame, plan: Plan) -> DataFrame:
    """Sources are few: their table is broadcast up to 10,000 rows, and joined by a shuffle beyond."""
    side = plan.catalogue().withColumnRenamed("source", "of")
    return out.join(F.broadcast(side) if len(plan.size) <= 10_000 else side, F.col("source").eqNullSafe(F.col("of")))


def mix_texts(docs: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """The mixture as documents: ``docs`` (doc_id, text, source, n_chars and more) with one row for
    each document and epoch, whose text is what the epoch takes of it, in the document's order.
    A whole text stays as it is; of a part the words are joined by one space. Documents without
    words (null or empty texts) have nothing to take and give no row. Rows equal in all columns are one
    document; null or shared doc_ids are documents of their own. Texts are read whole; an empty table
    gives an empty result. Other columns may have any names."""
    names, docs = docs.columns, plain(docs, KNOWN)
    sized = written(sizes(docs).dropDuplicates(["row"]), "sizes")
    keyed = with_row(docs)
    if docs.count() > sized.count():
        keyed = keyed.dropDuplicates(["_row"])
    taken = Plan(sized, seed, block).mixed().groupBy("row", "size", "epoch").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("parts"))
    joined = keyed.alias("d").join(taken.select(F.col("row").alias("_of"), F.col("size").alias("_size"), F.col("parts").alias("_parts")), F.col("d._row") == F.col("_of"))
    fields = docs.columns
    text, chars = fields.index("text"), fields.index("n_chars") if "n_chars" in fields else None

    def cut(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                columns = [part.column(i) for i in range(len(fields))]
                texts = []
                for whole, size, parts in zip(part.column("text").to_pylist(), part.column("_size").to_pylist(), part.column("_parts").to_pylist()):
                    if sum(p["n"] for p in parts) < size:
                        words = whole.encode().split()
                        whole = b" ".join(w for p in parts for w in words[p["first"] : p["first"] + p["n"]]).decode()
                    texts.append(whole)
                columns[text] = pa.array(texts, pa.string())
                if chars is not None:
                    columns[chars] = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    return joined.select(*[f"d.{c}" for c in fields], "_size", "_parts").mapInArrow(cut, docs.schema).toDF(*names)
