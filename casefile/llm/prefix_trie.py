"""The trie of conversations: every distinct beginning of a conversation is a node.

1. Turns are told apart by SHA-256 where they are read; from then on no text is moved. A turn's number in its
   conversation comes from ranges of (conv_id, turn) (``ranks``), so that one conversation may hold any share of all turns.
2. Rebuilt conversations are cut into bands of WIDTH turns; a band knows what stands before it by sums of hashes of
   (turn, position), which also name the nodes. A long conversation is many bands, and padding is bounded by WIDTH.
3. Bands are dealt by ranges of (what stands before, turn ids, conv_id) to shards. In each shard, rows of turn ids are a
   padded matrix, sorted by numpy's lexsort; where a row differs from the one before it, or'ed along the row, nodes start;
   reduceat sums up what belongs to each node, one depth after the other.
4. A shard learns of its neighbours' nearest rows, so that a node that several shards hold starts in one of them only.
   All that is said of such a node is a sum (or a minimum) of what its shards say. Nodes inside a shard are final there.

Sums over subtrees come from the leaves up without a walk: every node belongs to the row in which it starts, so
what a row's own nodes weigh from a depth on, added up over a node's rows, is its subtree. What a row's later bands weigh
comes from running sums over the bands of its conversation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.llm.common import written
from casefile.llm.ranks import ranked

#: Turns of a band; bands of a shard; bands of a conversation whose running sums one task takes.
WIDTH, SHARD_ROWS, SPAN = 16, 16_384, 1_024
#: Conversations whose numbers agree but for the remainder by GROUP share the beginning of the first of them, up to HEADS - 1 turns.
GROUP, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
NODES = "depth long, a long, b long, parent_a long, parent_b long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, open boolean, shard int"
CARRY = "conv_id long, band long, saved long, leaves long, shard int"
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_NODES, _CARRY = (pa.schema([(n, _KINDS[t]) for n, t in (x.split() for x in s.split(", "))]) for s in (NODES, CARRY))
SUMS = ["s0", "s1", "s2", "s3"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def heads_of(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return (F.crc32(conv.cast("string")) % HEADS).cast("long")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, id (of role and text) and words of every turn."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    id_ = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), id_.alias("id"), F.regexp_count(text, F.lit(WORD)).alias("words")).filter("conv_id is not null")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, pos, total, id and words of rebuilt conversations, from numbered turns (conv_id, idx, n, id,
    words). Of a conversation without any turn there is one row whose id is null."""
    convs = turns.filter("idx = 0").select("conv_id", F.expr(f"conv_id - conv_id % {GROUP}").alias("first"), "n", heads_of(F.col("conv_id")).alias("h"))
    head = F.least(F.col("h"), F.coalesce("of", F.lit(0))).alias("head")
    sizes = convs.filter("conv_id = first").select("first", F.col("n").alias("of"))
    convs = convs.join(sizes, "first", "left").select("conv_id", "first", "h", head, (F.least("h", F.coalesce("of", F.lit(0))) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    convs = written(convs, "convs")
    heads = turns.filter(f"idx < {HEADS - 1} and conv_id % {GROUP} = 0").select(F.col("conv_id").alias("first"), F.col("idx").alias("pos"), "id", "words")
    taken = convs.filter("head > 0").join(heads, "first").filter("pos < head").select("conv_id", "pos", "total", "id", "words")
    own = turns.join(convs, "conv_id").filter("idx >= h").select("conv_id", (F.col("idx") - F.col("h") + F.col("head")).alias("pos"), "total", "id", "words")
    none = convs.filter("total = 0").select("conv_id", F.lit(0).cast("long").alias("pos"), "total", F.lit(None).cast("binary").alias("id"), F.lit(0).alias("words"))
    return taken.unionByName(own).unionByName(none)


def running(df: DataFrame, key: str, order: str, values: list[str], back: bool = False) -> DataFrame:
    """``values`` summed over what comes before in ``order`` (with ``back``: after) in the same key, by SPAN rows
    and over these, so that no task sums up all rows of a hot key."""
    way = (lambda c: F.col(c).desc()) if back else F.col
    df = df.withColumn("_span", F.expr(f"{order} div {SPAN}"))
    inside = Window.partitionBy(key, "_span").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(key).orderBy(way("_span")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    spans = df.groupBy(key, "_span").agg(*[F.sum(v).alias(v) for v in values]).select(key, "_span", *[F.coalesce(F.sum(v).over(over), zero).alias(f"_{v}") for v in values])
    near = df.select("*", *[F.coalesce(F.sum(v).over(inside), zero).alias(f"_in_{v}") for v in values]).drop(*values)
    return near.join(spans, [key, "_span"]).select(*[c for c in df.columns if c not in values and c != "_span"], *[(F.col(f"_in_{v}") + F.col(f"_{v}")).alias(v) for v in values])


def bands(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """band, s0 .. s3 (sums over the turns before it), turns (array of f0, f1, words), more (whether the conversation goes on)
    and conv_id of each band. f0 and f1 are hashes of a turn at its position."""
    f0, f1 = F.xxhash64("id", "pos"), F.xxhash64("pos", "id", F.lit(7))
    hashed = turns.withColumn("f0", f0).withColumn("f1", f1).withColumn("band", F.expr(f"pos div {width}"))
    turn = F.when(F.col("id").isNotNull(), F.struct("pos", "f0", "f1", "words"))
    halves = [F.sum(F.expr(e)).alias(s) for s, e in zip(SUMS, ("f0 & 4294967295", "shiftrightunsigned(f0, 32)", "f1 & 4294967295", "shiftrightunsigned(f1, 32)"))]
    grouped = hashed.groupBy("conv_id", "band").agg(F.sort_array(F.collect_list(turn)).alias("turns"), (F.max("total") > (F.max("band") + 1) * width).alias("more"), *halves)
    grouped = written(grouped.withColumn("turns", F.transform("turns", lambda x: F.struct(x["f0"], x["f1"], x["words"]))), "bands")
    before = running(grouped.filter("more or band > 0").select("conv_id", "band", *SUMS), "conv_id", "band", SUMS).filter("band > 0")
    columns = ["band", *SUMS, "turns", "more", "conv_id"]
    first = grouped.filter("band = 0").select("band", *[F.lit(0).cast("long").alias(s) for s in SUMS], "turns", "more", "conv_id")
    return first.unionByName(grouped.filter("band > 0").drop(*SUMS).join(before, ["conv_id", "band"]).select(*columns))


class Shard:
    """The bands of one shard as a sorted matrix of turn ids, padded to its longest band."""

    def __init__(self, rows: pa.Table, side: pa.Table, width: int):
        self.width, self.shard = width, rows.column("shard")[0].as_py()
        lists = rows.column("turns").combine_chunks()
        flat, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
        row, col = np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        wide = max(int(size.max()), 1)
        matrix = {k: np.full((len(size), wide), np.iinfo(np.int64).min if k != "words" else 0, np.int64) for k in ("f0", "f1", "words")}
        for k, m in matrix.items():
            m[row, col] = flat.field(k).to_numpy()
        head = np.stack([rows.column(c).to_numpy() for c in ("band", *SUMS)])
        conv, more = rows.column("conv_id").to_numpy(), rows.column("more").to_numpy()
        keys = [conv, more] + [matrix[k][:, c] for c in range(wide - 1, -1, -1) for k in ("f1", "f0")] + list(head[::-1])
        order = np.lexsort(keys)
        self.f0, self.f1, self.words = (matrix[k][order] for k in ("f0", "f1", "words"))
        self.head, self.conv, self.more, self.size, self.wide = head[:, order], conv[order], more[order], size[order], wide
        self.before = self._shared(side.column("before")[0].as_py(), 0)
        self.after = self._shared(side.column("after")[0].as_py(), -1)
        # Whether a row's first k + 1 turns, and what stands before them, are those of the row above it.
        same = (self.head[:, 1:] == self.head[:, :-1]).all(axis=0)
        differs = (self.f0[1:] != self.f0[:-1]) | (self.f1[1:] != self.f1[:-1])
        differs[:, 0] |= ~same
        self.group = np.concatenate([[True], ~same])
        inside = np.arange(wide) < self.size[:, None]
        self.starts = np.vstack([inside[:1], np.logical_or.accumulate(differs, axis=1) & inside[1:]])
        self.new = self.starts.copy()
        self.new[0] &= np.arange(wide) >= self.before
        # A row ends in a leaf if its conversation ends with it and the next row is not of the same node.
        last, number = ~self.more, np.arange(len(self.size))
        same_below = np.concatenate([same, [self.after >= 0]])
        follows = np.zeros(len(size), bool)
        below = np.minimum(number + 1, len(size) - 1)
        at = np.maximum(self.size - 1, 0)
        follows[:-1] = (~self.starts[below, at])[:-1] & (self.size[below] >= self.size)[:-1]
        follows[:-1] |= (self.size == 0)[:-1]
        follows[-1] = self.after >= self.size[-1]
        self.leaf = (last & ~(same_below & follows)).astype(np.int64)
        self.own = self.words.sum(axis=1) - (self.words * self.new).sum(axis=1)

    def _shared(self, other: dict | None, mine: int) -> int:
        """How many first turns a neighbouring shard's nearest row shares with mine; -1 if not even what
        stands before."""
        if other is None or [other[c] for c in ("band", *SUMS)] != self.head[:, mine].tolist():
            return -1
        turns, k = other["turns"], 0
        while k < min(len(turns), int(self.size[mine])) and (turns[k]["f0"], turns[k]["f1"]) == (int(self.f0[mine, k]), int(self.f1[mine, k])):
            k += 1
        return k

    def carry(self) -> pa.Table:
        """What the bands of conversations with several of them weigh."""
        of = np.flatnonzero(self.more | (self.head[0] > 0))
        return pa.table([self.conv[of], self.head[0, of], self.own[of], self.leaf[of], np.full(len(of), self.shard, np.int32)], schema=_CARRY)

    def nodes(self, side: pa.Table, root: int) -> pa.Table:
        width, band = self.width, self.head[0]
        later = {(x["conv_id"], x["band"]): (x["saved"], x["leaves"]) for x in side.column("carries")[0].as_py() or ()}
        rest = np.zeros((2, len(self.conv)), np.int64)
        if later:
            for i in np.flatnonzero(self.more).tolist():
                rest[:, i] = later[int(self.conv[i]), int(band[i])]
        leaves = self.leaf + rest[1]
        saved = np.cumsum((self.words * ~self.new)[:, ::-1], axis=1)[:, ::-1] + rest[0][:, None]
        a0, b0 = (self.head[1 + k] + (self.head[2 + k] << 32) for k in (0, 2))
        a, b = a0[:, None] + np.cumsum(self.f0, axis=1), b0[:, None] + np.cumsum(self.f1, axis=1)
        out: list[list] = []
        number = np.arange(len(self.conv))
        # Depth 0 of a band: the node that its conversations have come to.
        at = np.flatnonzero(self.group)
        first = band[at] == 0
        zero = np.zeros(len(at), np.int64)
        reduced = [np.where(first, x, 0) for x in (np.diff(np.append(at, len(number))), np.add.reduceat(leaves, at), np.add.reduceat(saved[:, 0], at))]
        children = np.add.reduceat(self.new[:, 0].astype(np.int64), at)
        ended = (self.size == 0) & (band == 0)
        ends = [",".join(map(str, self.conv[ended])) if f else "" for f in first.tolist()]
        conv = [c if f else None for c, f in zip(np.minimum.reduceat(self.conv, at).tolist(), first.tolist())]
        out.append([band[at] * width, a0[at], b0[at], [None] * len(at), [None] * len(at), conv, [None] * len(at), reduced[0], children, reduced[1], reduced[2], ends, zero == 0])
        above: tuple | None = None
        for k in range(self.wide):
            rows = np.flatnonzero(self.size > k)
            if not len(rows):
                break
            at = np.flatnonzero(self.starts[rows, k])
            segment = np.cumsum(self.starts[:, k]) - 1
            convs = np.minimum.reduceat(self.conv[rows], at)
            count = np.diff(np.append(at, len(rows)))
            child = np.add.reduceat(self.new[rows, k + 1].astype(np.int64), at) if k + 1 < self.wide else np.zeros(len(at), np.int64)
            ended = (self.size[rows] == k + 1) & ~self.more[rows]
            n_ends = np.add.reduceat(ended.astype(np.int64), at)
            open_ = np.zeros(len(at), bool)
            if k + 1 == width:
                open_ |= np.add.reduceat(self.more[rows].astype(np.int64), at) > 0
            if rows[0] == 0 and self.before > k:
                open_[0] = True
            if rows[-1] == len(number) - 1 and self.after > k:
                open_[-1] = True
            texts = []
            for i, n in zip(at.tolist(), n_ends.tolist()):
                texts.append(",".join(map(str, self.conv[rows[i : i + n]].tolist())))
            texts = [t if o else hashlib.sha256(t.encode()).hexdigest() for t, o in zip(texts, open_.tolist())]
            start = rows[at]
            if k:
                parent = above[0][start]
                known = [None if o else c for c, o in zip(above[1][parent].tolist(), above[2][parent].tolist())]
                up_a, up_b = a[start, k - 1], b[start, k - 1]
            else:
                known = [root if f else None for f in (band[start] == 0).tolist()]
                up_a, up_b = a0[start], b0[start]
            out.append([band[start] * width + k + 1, a[start, k], b[start, k], up_a, up_b, convs, known, count, child, np.add.reduceat(leaves[rows], at), np.add.reduceat(saved[rows, k], at), texts, open_])
            above = (segment, convs, open_)
        tables = [pa.table([*x, np.full(len(x[0]), self.shard, np.int32)], schema=_NODES) for x in out]
        return pa.concat_tables(tables)


def _carries(width: int):
    return lambda rows, side: Shard(rows, side, width).carry()


def _nodes(width: int, root: int):
    return lambda rows, side: Shard(rows, side, width).nodes(side, root)


def _hashed(batches):
    """SHA-256 of the joined pieces of each node, which come together and in order; only the hash's state is held."""
    key, state = None, None
    schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("joined", pa.string())])
    for batch in batches:
        done = []
        for *now, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b", "ends"))):
            if now != key:
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=schema)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], schema=schema)


def conversation_trie(conversations: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations.

    ``conversations`` has conv_id, turn, role and text; other columns take no part. Turns come by turn (null first),
    equal ones by role, then by hash; equal rows are turns of their own. Null roles and texts are empty, texts are
    read whole. Rows without a conv_id belong to no conversation. An empty table has no conversation, so no node, not
    even a root. Two turns are held to be equal if 128 bits of their SHA-256 are."""
    spark = conversations.sparkSession
    turns = ranked(written(turns_of(conversations), "turns"), "conv_id", ["turn", "role", "id"], "numbered")
    found = written(bands(rebuilt(written(turns, "ranked")), width), "rows")
    size = found.count()
    if not size:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    root = found.agg(F.min("conv_id")).first()[0]
    shards = max(-(-size // shard_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = written(found.repartitionByRange(shards, "band", *SUMS, "turns", "more", "conv_id").withColumn("shard", F.spark_partition_id()), "shards")
    row = F.struct("band", *SUMS, "turns", "more", "conv_id")
    ends = rows.groupBy("shard").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    order = Window.orderBy("shard")
    side = written(ends.select("shard", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after")), "neighbours")
    joined = lambda side, f, schema: rows.groupBy("shard").cogroup(side.groupBy("shard")).applyInArrow(f, schema)
    carry = written(joined(side, _carries(width), CARRY), "carry")
    later = running(carry, "conv_id", "band", ["saved", "leaves"], back=True)
    later = later.groupBy("shard").agg(F.collect_list(F.struct("conv_id", "band", "saved", "leaves")).alias("carries"))
    nodes = written(joined(side.join(later, "shard", "left"), _nodes(width, root), NODES), "nodes")
    key = ["depth", "a", "b"]
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    shared = nodes.filter("open")
    pieces = shared.filter("ends <> ''").select(*key, "shard", "ends").repartition(*key).sortWithinPartitions(*key, "shard")
    hashes = pieces.mapInArrow(_hashed, "depth long, a long, b long, joined string")
    merged = shared.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), *[F.max(c).alias(c) for c in ("parent_a", "parent_b", "parent_conv_id")], *[F.sum(c).alias(c) for c in sums])
    merged = written(merged.join(hashes, key, "left").withColumn("ends", F.coalesce("joined", F.lit(NO_ENDS))), "merged")
    columns = ["conv_id", "depth", "parent_conv_id", *sums, F.col("ends").alias("ends_sha256")]
    all_ = nodes.filter("not open").select("parent_a", "parent_b", *columns).unionByName(merged.select("parent_a", "parent_b", *columns))
    known = all_.filter("parent_conv_id is not null or depth = 0").drop("parent_a", "parent_b")
    parents = merged.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("of"))
    looked_up = all_.filter("parent_conv_id is null and depth > 0").join(parents, ["depth", "parent_a", "parent_b"]).withColumn("parent_conv_id", F.col("of"))
    return known.select(*RESULT).unionByName(looked_up.select(*RESULT))
