"""Token ids written as canonical, length-limited Huffman codes in independent blocks.

1. Whole texts become ids; each worker remembers the ids of words that it has met, which the
   tokenizer encodes independently, and gathers a batch's ids in arrays.
2. Ids are counted over the whole table; the counts (one per id of the vocabulary, a proven bound)
   make code lengths by package-merge, and lengths make canonical codes.
3. Documents are ordered by doc_id in ranges; each block holds about BLOCK ids of consecutive
   documents, with the ids' number of each document and the bit offset of every STRIDE-th id.
4. Reading decodes a block by itself with one table look-up an id, at all checkpoints at once.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from casefile.llm.common import pieces, rows, written
from casefile.llm.ranks import range_bounds
from casefile.llm.word_ids import WordIds

END = 2
LIMIT = 18
BLOCK = 1 << 17
STRIDE = 256
#: Ids in a shard, a stretch of doc_ids that one task writes in order.
SHARD = 8 << 20
#: Where a null doc_id stands.
NULL, MOST_ID = -(1 << 63), (1 << 63) - 1
#: Bytes of text that are encoded at a time.
BATCH = 1 << 21
#: Words that a worker remembers.
WORDS = 600_000
#: White space other than space and newline.
OTHER = tuple("\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
#: Where any text may be cut with the same ids: at one space, before it, between two characters
#: that are no white space.
CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?= [^\s\x1c-\x1f\x85])")
SIGNS = ".,!?;:()[]{}\"'%&$#*+-/|<>=~^_@"
IS_SIGN, IS_LETTER = (np.array([chr(b) in SIGNS for b in range(256)]), np.array([b < 128 and chr(b).isalpha() for b in range(256)]))
#: Byte-level vocabularies write each byte as a character: printable ones as themselves.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in PRINTABLE)}
TOKENS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])


def id_type(vocabulary: int) -> type:
    """How ids are stored before they are coded."""
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


class Ids:
    """Ids of texts by a tokenizer file (byte-level, its pre-tokenizer cutting between white space,
    letters and signs). Texts whose white space is single spaces and newlines are cut at these, each
    word encoded once; the pieces of a word that the pre-tokenizer would cut go to the model."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.n = self.tokenizer.get_vocab_size()
        self.kind = id_type(self.n)
        self.known = WordIds([], self.words, WORDS)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def words(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with the space before it if it has one, in a row, and where each one's
        end. Letters only, or signs only, are one piece for the pre-tokenizer and go to the model."""
        whole, tokenize, ids, ends, at = data.tobytes(), self.tokenizer.model.tokenize, [], [], 0
        for n in size.tolist():
            word = whole[at : at + n].decode()
            at += n
            bare = word[1:] if word[0] == " " else word
            if not bare.isalpha() and bare.strip(SIGNS):
                ids += self.whole(word)
            elif word.isascii():
                ids += [t.id for t in tokenize("Ġ" + bare if bare is not word else word)]
            else:
                ids += [t.id for t in tokenize(word.encode().decode("latin-1").translate(LETTERS))]
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.array(ends, np.int64)

    def is_plain(self, t: str) -> bool:
        if "  " in t or "\n\n" in t or " \n" in t or "\n " in t or t[0] in " \n" or t[-1] in " \n":
            return False
        return not any(c in t for c in (OTHER[:8] if t.isascii() else OTHER)) and not any(x in t for x in self.special)

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (each with ``end``, if given) in a row, and where each text's end."""
        plain = np.array([bool(t) and self.is_plain(t) for t in texts], bool)
        data = [t.encode() for t, p in zip(texts, plain.tolist()) if p]
        size = np.array([len(t) for t in data], np.int64)
        data, stop = np.frombuffer(b"".join(data), np.uint8), np.cumsum(size)
        # A word begins at a space, a newline or behind one, and with its text; so do the signs with
        # which it ends.
        line = data == 10
        begins = line | (data == 32)
        begins[1:] |= line[:-1]
        begins[stop - size] = True
        sign = IS_SIGN[data]
        first, last = sign.copy(), sign.copy()
        first[1:] &= ~sign[:-1]
        last[:-1] &= ~sign[1:]
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        begins[first[IS_LETTER[data[first - 1]] & np.append(begins[1:], True)[last]]] = True
        start = np.flatnonzero(begins)
        ids, after = self.known.join(self.known.of(data, start, np.append(start[1:], len(data))[: len(start)]))
        after = np.append(0, after)[np.append(0, np.searchsorted(start, stop))]
        parts, n, nth = [], np.zeros(len(texts), np.int64), 0
        last = [np.array([end], np.uint32)] if end is not None else []
        for i, p in enumerate(plain.tolist()):
            if p:
                got = [ids[after[nth] : after[nth + 1]]]
                nth += 1
            elif any(x in texts[i] for x in self.special):
                got = [np.array(self.whole(texts[i]), np.uint32)]
            else:
                got = [np.array(self.whole(t), np.uint32) for t in CUT.split(texts[i])] if texts[i] else []
            got += last
            parts += got
            n[i] = sum(map(len, got))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.cumsum(n)


@functools.cache
def ids_of(path: str) -> Ids:
    return Ids(path)


def tokenized(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id, n and ids (16-bit for small vocabularies, else 32-bit; with the end id) of each text.
    The first row of some texts has their ids' counts, so that counting need not read the ids."""

    def run(batches):
        coder = ids_of(tokenizer)
        for batch in batches:
            for part in pieces(batch, "text", BATCH):
                ids, stop = coder.encode([t or "" for t in part.column("text").to_pylist()], end)
                n = np.bincount(ids)
                used = np.flatnonzero(n)
                counts = used.astype(np.uint32).tobytes() + n[used].astype(np.uint64).tobytes()
                data, width = ids.astype(coder.kind).tobytes(), np.dtype(coder.kind).itemsize
                size = np.diff(stop, prepend=0)
                begin = (stop - size) * width
                yield rows({"doc_id": part.column("doc_id").to_pylist(), "n": size.tolist(), "ids": [data[a:b] for a, b in zip(begin.tolist(), (stop * width).tolist())], "counts": [counts] + [None] * (len(size) - 1)}, TOKENS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids binary, counts binary")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no code over ``limit`` bits, by package-merge; 0 for
    ids that don't occur. Ties go to the smaller id."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.float64)
    n = len(used)
    levels = []  # of each level: where in its merged order the leaves stand
    packages = np.empty(0)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order)
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for order in reversed(levels):
        leaves = int((order[:take] < n).sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[used] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of increasing length, then id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for length in range(1, int(lengths.max(initial=0)) + 1):
        these = order[lengths[order] == length]
        code <<= length - before
        before = length
        codes[these] = np.arange(code, code + len(these), dtype=np.uint64)
        code += len(these)
    return codes


def packed(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The bits of documents (``sizes`` of them in ``ids``), each beginning at a byte, and the offset
    of each id's first bit from its document's."""
    n = lengths[ids]
    last = np.cumsum(sizes) - 1
    end = np.cumsum(n)
    before = np.append(0, end[last[:-1]])
    whole = -(-(end[last] - before) // 8)
    begin = np.cumsum(whole) - whole
    within = end - n - np.repeat(before, sizes)
    at = within + np.repeat(8 * begin, sizes)
    words = np.zeros(int(whole.sum()) // 8 + 2, np.uint64)
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    # Each code stands at the top of 64 bits, then moves to its place, in one word or two.
    top = (codes << (64 - lengths).astype(np.uint64) % np.uint64(64))[ids]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] |= np.bitwise_or.reduceat(top >> bit, first)
    over = np.flatnonzero(bit.astype(np.int64) + n > 64)
    words[word[over] + 1] |= top[over] << (np.uint64(64) - bit[over])
    data = words.astype(">u8").tobytes()
    return [data[a : a + b] for a, b in zip(begin.tolist(), whole.tolist())], within


def table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every string of so many bits: the id that begins it and the length of its code."""
    bits = max(1, int(lengths.max(initial=1)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    n = 1 << (bits - lengths[order])
    ids, size = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint8)
    ids[: n.sum()] = np.repeat(order, n)
    size[: n.sum()] = np.repeat(lengths[order], n)
    return ids, size, bits


BLOCKS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n", pa.int64()), ("offsets", pa.binary()), ("bits", pa.binary())])
CODED = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("within", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def stretches(tokens: DataFrame, total: int, shards: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of stretches of doc_ids that hold about as many ids each, and the number of shards of
    each stretch: one, but for a doc_id (or null) that alone has more ids than a shard, whose stretch is
    its own. The driver gets a number for each shard and each such doc_id, of which there are no more."""
    size = -(-total // shards) if shards else SHARD
    shards = shards or max(1, -(-total // SHARD))
    bounds = set(range_bounds(tokens, "doc_id", shards)) if shards > 1 else set()
    heavy = {NULL if r["doc_id"] is None else r["doc_id"]: r["n"] for r in tokens.groupBy("doc_id").agg(F.sum("n").alias("n")).filter(F.col("n") > 2 * size).collect()}
    ordered = np.array(sorted(bounds | set(heavy) | {h + 1 for h in heavy if h < MOST_ID}), np.int64)
    parts = np.ones(len(ordered) + 1, np.int64)
    for h, n in heavy.items():
        parts[np.searchsorted(ordered, h, side="right")] = -(-n // size)
    return ordered, parts


def huffman_write(tokens: DataFrame, vocabulary: int, limit: int = LIMIT, shards: int | None = None) -> tuple[DataFrame, list[int]]:
    """The written blocks of ``tokens`` (from ``tokenized``) in ascending doc_id order, and the code's
    lengths. Blocks are rows of a Parquet table in the shared folder: shard, block, the documents'
    ids and sizes, checkpoints and bits. A null doc_id comes first; equal ones stand by size and bits,
    where they fill several shards by a hash of their bits first. Each task writes one shard."""
    spark, kind = tokens.sparkSession, id_type(vocabulary)

    def count(batches):
        total = np.zeros(vocabulary, np.uint64)
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                k = len(x) // 12
                total[np.frombuffer(x, np.uint32, k)] += np.frombuffer(x, np.uint64, k, 4 * k)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used].astype(np.int64))], names=["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for row in tokens.select("counts").filter("counts is not null").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["id"]] = row["n"]  # at most one row for each id of the vocabulary
    lengths = code_lengths(counts, limit)
    bounds, parts = stretches(tokens, int(counts.sum()), shards)
    first = np.append(0, np.cumsum(parts))
    shards = int(first[-1])
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths), bounds, parts, first))

    def code(batches):
        """Each document's bits: packing comes before the shuffle, which then moves a third as much."""
        lengths, codes, bounds, parts, first = shared.value
        for batch in batches:
            for part in pieces(batch, "ids", 1 << 18):  # what numpy works on stays in the CPU's cache
                flat = np.frombuffer(b"".join(part.column("ids").to_pylist()), kind)
                size = part.column("n").to_numpy()
                bits, at = packed(flat, size, codes, lengths)
                begin = np.cumsum(size) - size
                offsets = [at[a : a + n : STRIDE].astype(np.uint64).tobytes() for a, n in zip(begin.tolist(), size.tolist())]
                ids = part.column("doc_id")
                stretch = np.searchsorted(bounds, ids.fill_null(NULL).to_numpy(), side="right")
                # Documents of one id that fill several shards are dealt by their bits.
                hashed = np.array([zlib.crc32(x) for x in bits], np.uint64)
                shard = first[stretch] + (hashed * parts[stretch].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard), ids, part.column("n"), pa.array(offsets, pa.binary()), pa.array(bits, pa.binary())], names=["shard", "doc_id", "n", "offsets", "bits"])

    coded = tokens.select("doc_id", "n", "ids").mapInArrow(code, "shard long, doc_id long, n long, offsets binary, bits binary")
    ordered = coded.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "doc_id", "n", "bits")

    def block(batches):
        """Blocks of consecutive documents; each document begins at a byte of its own."""
        number, held, total = 0, [], 0
        shard = -1

        def full():
            offsets, bits, base = [], [], 0
            for _, n, at, data in held:
                offsets.append(np.frombuffer(at, np.uint64) + np.uint64(8 * base))
                bits.append(data)
                base += len(data)
            one = {"shard": [shard], "block": [number], "doc_ids": [[h[0] for h in held]], "sizes": [[h[1] for h in held]], "n": [total], "offsets": [np.concatenate(offsets).tobytes()], "bits": [b"".join(bits)]}
            return rows(one, BLOCKS)

        for batch in batches:
            for d, n, at, data, s in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "offsets", "bits", "shard"))):
                if s != shard:
                    if held:
                        yield full()
                    shard, number, held, total = s, 0, [], 0
                held.append((d, n, at, data))
                total += n
                if total >= BLOCK:
                    yield full()
                    number, held, total = number + 1, [], 0
        if held:
            yield full()

    blocks = ordered.mapInArrow(block, "shard long, block long, doc_ids array<long>, sizes array<long>, n long, offsets binary, bits binary")
    return written(blocks, "huffman"), lengths.tolist()


def huffman_read(blocks: DataFrame, lengths: list[int], keep_ids: bool = False) -> DataFrame:
    """The documents of written blocks: shard, block, within (ids before it in the block), doc_id, n_tokens,
    ids_crc32, and with ``keep_ids`` the ids."""
    schema = "shard long, block long, within long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    shared = blocks.sparkSession.sparkContext.broadcast(np.array(lengths, np.int64))

    def run(batches):
        of = table(shared.value)
        for batch in batches:
            for shard, number, docs, sizes, offsets, bits in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "doc_ids", "sizes", "offsets", "bits"))):
                ids = unpacked_documents(bits, np.array(sizes, np.int64), np.frombuffer(offsets, np.uint64), of)
                out = {"shard": [shard] * len(docs), "block": [number] * len(docs), "within": (np.cumsum(sizes) - np.array(sizes)).tolist(), "doc_id": docs, "n_tokens": sizes, "ids_crc32": [zlib.crc32(x) for x in ids]}
                columns = [pa.array(out[f.name], f.type) for f in CODED]
                names = list(CODED.names)
                if keep_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.mapInArrow(run, schema)


def unpacked_documents(data: bytes, sizes: np.ndarray, checkpoints: np.ndarray, of: tuple) -> list[np.ndarray]:
    """Ids of a block's documents. Each checkpoint decodes STRIDE ids, or what its document has left."""
    ids, size, bits = of
    runs = -(-sizes // STRIDE)
    todo = np.full(int(runs.sum()), STRIDE, np.int64)
    last = np.cumsum(runs) - 1
    todo[last] = sizes - (runs - 1) * STRIDE
    raw = np.frombuffer(data + bytes(8), np.uint8)
    ahead = raw[:-3].astype(np.uint32) << 24 | raw[1:-2].astype(np.uint32) << 16 | raw[2:-1].astype(np.uint32) << 8 | raw[3:]
    order = np.argsort(-todo, kind="stable")
    at, left = checkpoints[order].astype(np.int64), todo[order]
    place = (np.cumsum(todo) - todo)[order]
    out = np.zeros(int(todo.sum()), np.uint32)
    active = np.searchsorted(-left, -np.arange(STRIDE), side="left")
    for k in range(int(left[0]) if len(left) else 0):
        m = int(active[k])
        now = at[:m]
        window = ahead[now >> 3] << (now & 7).astype(np.uint32) >> np.uint32(32 - bits)
        out[place[:m] + k] = ids[window]
        at[:m] += size[window]
    return np.split(out, np.cumsum(sizes)[:-1])


def with_starts(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """``start``: the ids of all documents before. Sums are taken over shards, over the blocks of a
    shard and inside each block, so that no task orders more than one row for each shard or block."""
    totals = blocks.select("shard", "block", F.col("n").alias("t"))
    shards = totals.groupBy("shard").agg(F.sum("t").alias("t"))
    before = shards.withColumn("b0", F.coalesce(F.sum("t").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "b0")
    w = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("b1", F.coalesce(F.sum("t").over(w), F.lit(0))).join(before, "shard").select("shard", "block", (F.col("b0") + F.col("b1")).alias("base"))
    return documents.join(base, ["shard", "block"]).withColumn("start", F.col("base") + F.col("within")).drop("base")


def huffman_token_files(docs: DataFrame, tokenizer: str, vocabulary: int, end: int = END) -> DataFrame:
    """Write the ids of every whole text and read them back: doc_id, start, n_tokens, ids_crc32.

    ``docs`` has doc_id and text; other columns are ignored. Null and empty texts have the end id
    only. A null doc_id comes before all others; repeated doc_ids each keep a row (see
    ``huffman_write`` for their order). Texts are encoded whole, however long. An empty table gives an empty result.
    """
    tokens = written(tokenized(docs, tokenizer, end), "tokens")
    blocks, lengths = huffman_write(tokens, vocabulary)
    return with_starts(huffman_read(blocks, lengths), blocks).select("doc_id", "start", "n_tokens", "ids_crc32")
