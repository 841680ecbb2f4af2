"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.session import scratch, shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: this cuts lineage, so later
    stages survive the loss of any executor without recomputing what came before."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for small tables inside loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def plain(docs: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """``docs`` with its other columns than ``known`` ones under names that need no quotes and clash with none of ours.
    ``toDF(*docs.columns)`` gives them back."""
    return docs.toDF(*[c if c in known else f"other_{i}" for i, c in enumerate(docs.columns)])


def with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with _row, a key of the whole row; only equal rows share one."""
    parts = [F.coalesce(F.md5("text"), F.lit("-"))] + [F.coalesce(F.concat(F.lit("+"), F.md5(F.col(c).cast("string"))), F.lit("-")) for c in docs.columns if c != "text"]
    return docs.withColumn("_row", F.md5(F.concat_ws("|", *parts)))


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text as UTF-8; none for null. bytes.split() without arguments cuts at
    exactly space, \\t, \\n, \\v, \\f and \\r."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def give_back() -> None:
    """Hand freed memory back to the system: a worker lives on from task to task, and what its largest one took would
    stay with it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(run):
    """A function over batches that begins and ends with no more memory than it holds."""

    def inner(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def rows(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Slices of a batch holding about ``most`` bytes of ``column`` each (one row at least), so that
    what a task holds at a time does not grow with the length of texts."""
    size = pc.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, n in enumerate(size):
        if total and total + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += (n or 0) + 64
    if start < batch.num_rows:
        yield batch.slice(start)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except AttributeError:  # another C library than GNU's
    _trim = None

U = np.uint64
#: Bytes that are hashed at a time: what numpy works on stays in the CPU's cache. Longer spans than
#: LONG_SPAN are hashed one by one.
PIECE, LONG_SPAN = 1 << 17, 256
#: For each of the two hashes of a span: a random number for each byte, and the powers of an odd base
#: by which they are weighted.
_random = np.random.default_rng(35)
LETTERS = _random.integers(0, 1 << 63, (2, 256), U) * U(2) + U(1)
POWERS = np.array([[pow(int(base), k, 1 << 64) for k in range(LONG_SPAN + 1)] for base in _random.integers(0, 1 << 62, 2, U) * U(4) + U(3)], U)
#: Letters for spans with blanks between them.
WORD_LETTERS = LETTERS.copy()
WORD_LETTERS[:, [9, 10, 11, 12, 13, 32]] = 0


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span of bytes. Spans come in order; what lies between them has a
    letter of 0."""
    out, a = (np.empty(len(start), U), np.empty(len(start), U)), 0
    long = end - start > LONG_SPAN
    while a < len(start):
        low = int(start[a])
        b = max(a + 1, int(np.searchsorted(end, low + PIECE, side="right")))
        if b > a + 1 or not long[a]:
            piece, segment = data[low : end[b - 1]].astype(np.intp), start[a:b] - low
            nth = np.arange(len(piece)) - np.repeat(segment, np.diff(segment, append=len(piece)))
            np.minimum(nth, LONG_SPAN, out=nth)
            for h, letter, power in zip(out, letters, POWERS):
                h[a:b] = mixed(np.add.reduceat(letter[piece] * power[nth], segment))
        a = b
    for i in np.flatnonzero(long).tolist():
        h = xxhash.xxh3_128_intdigest(data[start[i] : end[i]].tobytes())
        out[0][i], out[1][i] = h >> 64, h & 0xFFFFFFFFFFFFFFFF
    return out
