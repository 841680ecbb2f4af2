"""Exact removal of word windows that occur more than once, behind a Count-min prefilter.

Plan (one lazy query; the text is shuffled once and its exchange reused by all three passes):

1. Documents are dealt to chunks by a hash. Each chunk sketches its windows: two rows of counters,
   saturating at 2, sent sparsely as the sorted cells it touches. A slice of the counters is merged
   over all chunks by one group, which answers every chunk with one bit per cell sent: "2 or more".
2. A window is estimated repeated if all its cells are. Estimates are never too low, so no repeated
   window is lost. Only those windows send an exact 96-bit key; a group per slice of the keys counts
   them and again answers every chunk with one bit per key. What the chunk sent it notes down, so
   that the third pass hashes nothing.
3. Each chunk removes the words that repeated windows cover.

Words are found, hashed and cut in numpy arrays over a chunk's bytes, never as Python objects.
Counters, slices and chunks all grow with the input; nothing is broadcast or collected but a row
and byte count. A chunk sends a window at most twice however often it occurs there, so copies,
hot passages or a hot source never gather in one task. Where chunks times slices would be too many
messages, both go through relays (``fan``): a group of chunks sends to a slice as one.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casefile.llm.common import WORD_LETTERS, mixed, span_hashes

WINDOW = 35
CHUNK_BYTES = 8 << 20
SLICE_CELLS = 4_000_000
#: Words whose windows are hashed at a time.
RUN = 1 << 15
#: Messages (chunks times slices) up to which chunks send to slices directly.
MESSAGES = 4_000_000
ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
U = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def text_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and the last ends; null is empty."""
    texts = pa.chunked_array([pc.fill_null(c, "").cast(pa.large_string()) for c in column.chunks], pa.large_string()).combine_chunks()
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends. In UTF-8 blanks are single bytes; a text's end ends a word."""
    solid = ~BLANK[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    begin, end = at[:-1][at[:-1] < len(data)], at[1:][at[1:] > 0] - 1
    first[begin], last[end] = solid[begin], solid[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def window_keys(hashes: tuple[np.ndarray, np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run of ``window`` words."""
    n = len(hashes[0]) - window + 1
    out = tuple(np.empty(max(0, n), U) for _ in hashes)
    for col, base, to in zip(hashes, ODD, out):
        for a in range(0, n, RUN):
            b = min(a + RUN, n)
            to[a:b] = mixed(runs(col[a : b + window - 1], base, window))
    return out


def runs(col: np.ndarray, base: np.uint64, window: int) -> np.ndarray:
    """Polynomials in an odd base, mod 2^64, of each run of ``window`` numbers, built by doubling:
    ``run`` has those of ``length`` numbers; ``weight`` is the base to the power ``length``."""
    done, acc, run, weight = 0, None, col, base
    n, rest, length = len(col) - window + 1, window, 1
    while rest:
        if rest & 1:
            part = run[done : done + n]
            acc = part.copy() if acc is None else acc * weight + part
            done += length
        rest >>= 1
        if rest:
            run = run[: len(run) - length] * weight + run[length:]
            length *= 2
            weight = U(int(weight) ** 2 & 0xFFFFFFFFFFFFFFFF)
    return acc


class Chunk:
    """The words and windows of one chunk's documents, in an order that only they decide."""

    def __init__(self, docs: pa.Table, window: int):
        self.table = docs = docs.sort_by([("text", "ascending"), ("doc_id", "ascending")])
        self.window = window
        self.data, self.at = text_bytes(docs.column("text"))
        self.start, self.end = word_bounds(self.data, self.at)
        #: Of each document: its first word, and that of the next.
        self.first = np.searchsorted(self.start, self.at)
        count = np.maximum(np.diff(self.first) - window + 1, 0)
        #: Of each window: its first word.
        self.word = np.arange(count.sum()) + np.repeat(self.first[:-1] - np.cumsum(count) + count, count)

    def hash(self) -> Chunk:
        self.k1 = self.k2 = np.empty(0, U)
        if len(self.word):
            self.k1, self.k2 = (k[self.word] for k in window_keys(span_hashes(self.data, self.start, self.end, WORD_LETTERS), self.window))
        return self

    def without(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What is left without the words that ``windows`` (numbers) cover: the bytes of all texts'
        words joined by one space, where each text begins and ends in them, and the words removed."""
        edge = np.zeros(len(self.start) + 1, np.int32)
        edge[self.word[windows]] += 1
        edge[self.word[windows] + self.window] -= 1
        kept = np.cumsum(edge[:-1]) == 0
        removed = np.diff(np.append(0, np.cumsum(~kept))[self.first])
        # A kept word takes the blank after it along, unless its text ends there.
        ends = np.zeros(len(self.data) + 1, bool)
        ends[self.at] = True
        start, end = self.start[kept], self.end[kept]
        blank = ~ends[end]
        stop = end + blank
        mark = np.zeros(len(self.data) + 1, np.int8)
        mark[start] += 1
        mark[stop] -= 1
        data = self.data.copy()
        data[end[blank]] = 32
        data = data[np.cumsum(mark[:-1], dtype=np.int8).view(bool)]
        size = np.zeros(len(self.start), np.int64)
        size[kept] = stop - start
        at = np.append(0, np.cumsum(size))[self.first]
        begin, end = at[:-1], at[1:].copy()
        some = end > begin
        end[some] -= data[end[some] - 1] == 32
        return data, begin, end, removed

    def cells(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        shift = U(64 - bits)
        return self.k1 >> shift, (self.k2 >> shift) + U(1 << bits)

    def sent_cells(self, bits: int) -> np.ndarray:
        return np.concatenate([twice(x) for x in self.cells(bits)])

    def repeated(self, sent: np.ndarray, answer: np.ndarray, bits: int) -> np.ndarray:
        """Numbers of the windows whose cells all count 2 or more, ordered by exact key."""
        hot = sent[answer]
        hot = hot[np.diff(hot, prepend=U(0xFFFFFFFFFFFFFFFF)) != 0]
        a, b = self.cells(bits)
        left = np.flatnonzero(among(a, hot))
        left = left[among(b[left], hot)]
        return left[np.lexsort((self.tail(left), self.k1[left]))]

    def tail(self, which: np.ndarray) -> np.ndarray:
        return (self.k2[which] >> U(8)).astype(np.uint32)

    def sent_keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, each at most twice, and for each window whether its key is a new one."""
        k1, k2 = self.k1[which], self.tail(which)
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        take, _ = taken(new)
        return k1[take], k2[take], new


def taken(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ordered keys, given which are new: the places of those sent (of equal ones two), and for
    each key where the first equal one stands among those sent."""
    first = np.flatnonzero(new)
    second = first[np.diff(np.append(first, len(new))) > 1] + 1
    take = np.sort(np.concatenate([first, second]))
    return take, np.searchsorted(take, first)[np.cumsum(new) - 1]


def twice(x: np.ndarray) -> np.ndarray:
    """Sorted values, each at most twice: a counter that saturates at 2."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[2:] = x[2:] != x[:-2]
    return x[keep]


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``x`` occur in ``ordered``. A table of their last bits sorts out most of the others."""
    low = U((1 << max(16, min(22, (8 * len(ordered)).bit_length()))) - 1)
    some = np.zeros(int(low) + 1, bool)
    some[ordered & low] = True
    out = some[x & low]
    may = np.flatnonzero(out)
    if len(may):
        y = x[may]
        out[may] = ordered[np.minimum(np.searchsorted(ordered, y), len(ordered) - 1)] == y
    return out


def packed_cells(cells: np.ndarray) -> bytes:
    """Gaps between sorted cells by byte planes; the upper planes are nearly constant."""
    gaps = np.diff(cells, prepend=U(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    planes = gaps.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def unpacked_cells(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, : data[0]] = planes.T
    return np.cumsum(gaps.view(U).ravel())


#: The level of answers that are a chunk's own notes.
NOTES = 3
MESSAGE = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary())])
ANSWER = pa.schema([("chunk", pa.int64()), ("level", pa.int32()), ("part", pa.int64()), ("mask", pa.binary())])
RESULT_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def ranges(of: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, start, end) of the equal stretches of a sorted array of part numbers."""
    edge = np.flatnonzero(np.diff(of, prepend=-1, append=parts))
    return [(int(of[a]), int(a), int(b)) for a, b in itertools.pairwise(edge)]


def messages(chunk: int, payloads: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([[p for p, _ in payloads], [chunk] * len(payloads), [d for _, d in payloads]], schema=MESSAGE)


def answers_for(table: pa.Table, level: int, n: int) -> np.ndarray:
    """The bits that all slices sent back to a chunk, in the order of what it sent."""
    got = sorted((p, m) for l, p, m in zip(*(table.column(c).to_pylist() for c in ("level", "part", "mask"))) if l == level)
    out = np.concatenate([np.zeros(0, bool), *[unmasked(m)[0] for _, m in got]])
    if len(out) != n:
        raise ValueError(f"a chunk sent {n} counters and got {len(out)} answers")
    return out


def mask(bits: np.ndarray) -> bytes:
    return len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes()


def unmasked(data: bytes) -> tuple[np.ndarray, int]:
    """The bits of a mask at the beginning of ``data``, and the bytes that it has."""
    n = int.from_bytes(data[:8], "little")
    return np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), 8), count=n).view(bool), 8 + -(-n // 8)


def combined(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and which are new in it."""
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


class Travel:
    """How counters (``cells``) or keys are written to a message, and which slice each goes to."""

    def __init__(self, cells: bool, parts: int, span: int, fan: int):
        self.cells, self.parts, self.span, self.fan = cells, parts, span, fan

    def of(self, k1: np.ndarray) -> np.ndarray:
        if self.cells:
            return (k1 // U(self.span)).astype(np.int64)
        return ((k1 >> U(32)) * U(self.parts) >> U(32)).astype(np.int64)

    def pack(self, k1: np.ndarray, k2: np.ndarray) -> bytes:
        return packed_cells(k1) if self.cells else k1.tobytes() + k2.tobytes()

    def unpack(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        if self.cells:
            k1 = unpacked_cells(data)
            return k1, np.zeros(len(k1), np.uint32)
        n = len(data) // 12
        return np.frombuffer(data, U, n), np.frombuffer(data, np.uint32, n, 8 * n)

    def split(self, k1: np.ndarray, k2: np.ndarray, fan: int) -> list[tuple[int, bytes]]:
        """Messages of ordered keys to slices, or (``fan`` over 1) to bands of as many slices."""
        return [(p, self.pack(k1[a:b], k2[a:b])) for p, a, b in ranges(self.of(k1) // fan, -(-self.parts // fan))]

    def together(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """The keys of several messages as one sender would send them: k1, k2, the order of all keys,
        and where each of them stands among those sent; the number of keys of each message."""
        got = [self.unpack(x.as_py()) for x in table.column("payload")]
        k1, k2 = (np.concatenate(x) for x in zip(*got))
        order, new = combined(k1, k2)
        take, where = taken(new)
        return k1[order][take], k2[order][take], order, where, [len(x) for x, _ in got]


def answered(sent: DataFrame, merge, travel: Travel, level: int) -> DataFrame:
    """The slices' answers to chunks' messages. With a fan over 1, so many chunks send through relays,
    one for each band of so many slices: a relay sends the keys of its chunks to each slice once, and
    answers its chunks. Messages to negative slices are a chunk's notes to itself: they come back."""
    message, answer = "part long, chunk long, payload binary", "chunk long, level int, part long, mask binary"
    if (fan := travel.fan) == 1:
        return sent.groupBy("part").applyInArrow(lambda key, table: noted(table) if key[0].as_py() < 0 else merge(key, table), answer)

    def up(key, table):
        if key[1].as_py() < 0:
            return messages(0, [])
        k1, k2, *_ = travel.together(table)
        return messages(key[0].as_py(), travel.split(k1, k2, 1))

    def down(key, table, answers):
        if key[1].as_py() < 0:
            return noted(table)
        k1, _, order, where, n = travel.together(table)
        bits = np.empty(len(order), bool)
        bits[order] = answers_for(answers, level, len(k1))[where]
        masks = [mask(x) for x in np.split(bits, np.cumsum(n)[:-1])]
        return pa.table([table.column("chunk").to_pylist(), [level] * len(n), [key[1].as_py()] * len(n), masks], schema=ANSWER)

    sent = sent.withColumn("team", F.expr(f"chunk div {fan}"))
    by_slice = sent.groupBy("team", "part").applyInArrow(up, message).groupBy("part").applyInArrow(merge, answer)
    back = by_slice.select(F.col("chunk").alias("team"), F.expr(f"part div {fan}").alias("band"), "level", "part", "mask")
    return sent.groupBy("team", "part").cogroup(back.groupBy("team", "band")).applyInArrow(down, answer)


def noted(table: pa.Table) -> pa.Table:
    n = table.num_rows
    return pa.table([table.column("chunk"), pa.array([NOTES] * n, pa.int32()), table.column("part"), table.column("payload")], schema=ANSWER)


def substring_dedup(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, slice_cells: int = SLICE_CELLS, carry: list[str] | None = None, fan: int | None = None) -> DataFrame:
    """Remove each word that a repeated window covers.

    ``docs`` has doc_id (whole number) and text; other columns, whatever their names, are ignored.
    A word is a run of characters other than space and \\t..\\r. A window is ``window`` consecutive
    words of one document; it is repeated if the same words also start anywhere else, in the same
    document or another. Windows are judged on the input.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and,
    with ``carry`` (names of further columns of ``docs``, or none), these and kept_text: the kept
    words so joined, or the text as it is where nothing is removed. Defined cases: a null or empty text has no words; texts under
    ``window`` words lose nothing; repeated rows (equal doc_id and text, too) are documents of their
    own and so lose all that their windows cover; a null doc_id is kept as null; an empty table
    gives an empty result. A text is never cut, however long: it makes its chunk larger. Equality of
    windows is equality of two hashes, 96 bits in all. ``fan``: see ``answered``; by default it follows
    from the input's size, and the result does not depend on it.
    """
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    total = (size["b"] or 0) + 64 * size["n"]
    chunks = max(1, math.ceil(total / chunk_bytes))
    words = max(1, total // 6)
    bits = max(16, math.ceil(math.log2(4 * words)))
    cell_parts = max(1, math.ceil(2 * words / slice_cells))
    key_parts = max(1, math.ceil(words / slice_cells))
    span = -(-(2 << bits) // cell_parts)
    fan = fan or max(1, min(math.ceil(chunks * cell_parts / MESSAGES), math.isqrt(cell_parts)))
    by_cell, by_key = Travel(True, cell_parts, span, fan), Travel(False, key_parts, 0, fan)

    kept = [] if carry is None else [f"carry_{k}" for k in range(len(carry))]
    by = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *[F.col(c).alias(k) for c, k in zip(carry or [], kept)])
    # Equal rows are told apart by the partition that they come from, so that they don't share a chunk.
    by = by.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)))
    result = T.StructType([*T.StructType.fromDDL(RESULT_DDL).fields, *[by.schema[k] for k in kept], *([T.StructField("kept_text", T.StringType())] if carry is not None else [])])

    def sketch(key, table):
        sent = Chunk(table, window).hash().sent_cells(bits)
        return messages(key[0].as_py(), by_cell.split(sent, sent, fan))

    def merge(key, table):
        counts = np.zeros(span, np.uint8)
        sent = [(unpacked_cells(x.as_py()) - U(key[0].as_py() * span)).astype(np.int64) for x in table.column("payload")]
        for cells in sent:
            again = np.flatnonzero(np.diff(cells, prepend=-1) == 0)
            once = np.delete(cells, again) if len(again) else cells
            counts[once] = np.minimum(counts[once] + 1, 2)
            counts[cells[again]] = 2
        return pa.table([table.column("chunk").to_pylist(), [1] * len(sent), [key[0].as_py()] * len(sent), [mask(counts[c] > 1) for c in sent]], schema=ANSWER)

    def exact(key, table, answers):
        chunk, number = Chunk(table, window).hash(), key[0].as_py()
        sent = chunk.sent_cells(bits)
        which = chunk.repeated(sent, answers_for(answers, 1, len(sent)), bits)
        k1, k2, new = chunk.sent_keys(which)
        note = mask(new) + which.astype(np.uint32).tobytes()
        return messages(number, [(-1 - number, note), *by_key.split(k1, k2, fan)])

    def count(key, table):
        k1, _, order, where, n = by_key.together(table)
        group = np.cumsum(np.diff(where, prepend=-1) > 0) - 1
        many = np.empty(len(order), bool)
        many[order] = (np.bincount(group) > 1)[group]
        masks = [mask(x) for x in np.split(many, np.cumsum(n)[:-1])]
        return pa.table([table.column("chunk").to_pylist(), [2] * len(n), [key[0].as_py()] * len(n), masks], schema=ANSWER)

    def remove(key, table, answers):
        chunk = Chunk(table, window)
        note = next(m for m, level in zip(answers.column("mask").to_pylist(), answers.column("level").to_pylist()) if level == NOTES)
        new, used = unmasked(note)
        which = np.frombuffer(note, np.uint32, offset=used)
        take, where = taken(new)
        gone = which[answers_for(answers, 2, len(take))[where]]
        data, begin, end, removed = chunk.without(gone)
        left = memoryview(data)
        spans = list(zip(begin.tolist(), end.tolist()))
        sha = [hashlib.sha256(left[a:b]).hexdigest() for a, b in spans]
        done = pa.table([chunk.table.column("doc_id"), pa.array(np.diff(chunk.first)), pa.array(removed), pa.array(sha, pa.string())], schema=RESULT)
        if carry is not None:
            for k in kept:
                done = done.append_column(k, chunk.table.column(k))
            texts = [bytes(left[a:b]).decode() if n else whole.as_py() for (a, b), n, whole in zip(spans, removed.tolist(), chunk.table.column("text"))]
            done = done.append_column("kept_text", pa.array(texts, pa.string()))
        return done

    message = "part long, chunk long, payload binary"
    estimated = answered(by.groupBy("chunk").applyInArrow(sketch, message), merge, by_cell, 1)
    keys = by.groupBy("chunk").cogroup(estimated.groupBy("chunk")).applyInArrow(exact, message)
    out = by.groupBy("chunk").cogroup(answered(keys, count, by_key, 2).groupBy("chunk")).applyInArrow(remove, result)
    return out.withColumnsRenamed(dict(zip(kept, carry or [])))
