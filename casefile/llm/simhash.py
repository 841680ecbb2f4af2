"""SimHash near-duplicates by anchor points.

A fingerprint is compared within the balls around the codewords (anchors) of a covering code: the
binary Golay code, whose 4096 words of 23 bits have every 23-bit string within 3 of exactly one of
them. A projection takes one or more fields of up to 23 bits. A fingerprint is at home at the
anchor nearest in every field, and visits all anchors whose distance exceeds the covering radius by
at most ``threshold`` over all fields together. If two fingerprints differ in ``threshold`` bits of
a projection or fewer, one visits the other's home (triangle inequality), so no link is lost.

For distances up to 2, one projection of two fields gives 2^24 anchors and about 61 visits. Greater
distances up to ``3 * parts - 1`` use several projections: one of them holds 2 differing bits or
fewer (pigeonhole).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.llm.common import pieces, rows, written
from casefile.llm.components import connected_components

U = np.uint64
SEED = 42
RADIUS, BITS, CHECKS = 3, 23, 11
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code.
GENERATOR = 0b110001110101
#: A home with more fingerprints is split; each part gets all of its visitors.
HOME = 4096
#: Fingerprints whose connections a task remembers, so as not to give a link again.
KNOWN = 200_000
#: (lane, shift, width) of the fields of each projection.
PAIR = [[(0, 0, 23), (0, 23, 23)]]


def thirds(lanes: int) -> list[list[tuple[int, int, int]]]:
    """Three projections of each 64-bit lane: all distances up to 8 within a lane, and most of those
    somewhat greater (a distance of 9 is missed only if it falls in 3, 3 and 3)."""
    return [[(lane, shift, width)] for lane in range(lanes) for shift, width in ((0, 21), (21, 21), (42, 22))]


def _syndromes() -> np.ndarray:
    """The remainder of each 23-bit string by the generator."""
    rest = np.arange(1 << BITS, dtype=np.uint32)
    for bit in range(BITS - 1, CHECKS - 1, -1):
        rest ^= ((rest >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - CHECKS))
    return rest.astype(np.uint16)


@functools.cache
def ball(threshold: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Syndromes, and for each excess over the radius: errors ordered by syndrome, with the first
    of each syndrome and their number."""
    syndromes, out = _syndromes(), []
    weight = np.bitwise_count(np.arange(1 << BITS, dtype=np.uint32))
    for excess in range(threshold + 1):
        errors = np.flatnonzero(weight <= RADIUS if not excess else weight == RADIUS + excess).astype(U)
        errors = errors[np.argsort(syndromes[errors], kind="stable")]
        n = np.bincount(syndromes[errors], minlength=1 << CHECKS)
        out.append((errors, np.cumsum(n) - n, n))
    return syndromes, out


def anchors(prints: np.ndarray, fields: list[tuple[int, int, int]], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of fingerprints (rows of lanes): their numbers, the anchors they go to, and the excess; the
    anchor with excess 0 is the home."""
    syndromes, errors = ball(threshold)
    who, anchor, spent = np.arange(len(prints)), np.zeros(len(prints), U), np.zeros(len(prints), np.int8)
    for k, (lane, shift, width) in enumerate(fields):
        x = (prints[:, lane] >> U(shift)) & U((1 << width) - 1)
        found = []
        for excess, (all_errors, first, number) in enumerate(errors):
            can = np.flatnonzero(spent + excess <= threshold)
            s = syndromes[x[who[can]]]
            n = number[s]
            flat = np.repeat(can, n)
            nth = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            word = x[who[flat]] ^ all_errors[np.repeat(first[s], n) + nth]
            found.append((who[flat], anchor[flat] | word << U(BITS * k), spent[flat] + np.int8(excess)))
        who, anchor, spent = (np.concatenate(c) for c in zip(*found))
    return who, anchor, spent


FINGERPRINT = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.binary())])


def fingerprint(words: list[bytes], shingle: int, lanes: int) -> bytes:
    """Big-endian lanes of 64 bits. Lane 0 has XXH64 with seed 42; further lanes other seeds."""
    if not words:
        return bytes(8 * lanes)
    text, n = b" ".join(words), max(1, len(words) - shingle + 1)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(length) - length
    end = (start + length - 1)[-n:].tolist()
    parts = [text[a:b] for a, b in zip(start.tolist(), end)]
    out = b""
    for lane in range(lanes):
        h = np.array([xxhash.xxh64_intdigest(x, SEED + lane) for x in parts], U).astype(">u8")
        count = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            count += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out += np.packbits(2 * count > n).tobytes()
    return out


#: Only A to Z change.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprints(docs: DataFrame, shingle: int = 3, lanes: int = 1) -> DataFrame:
    """doc_id and the fingerprint (binary) of each whole text; words as in the module's operator."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                prints = [fingerprint((t.as_py() or "").encode().translate(LOWER).split(), shingle, lanes) for t in part.column("text")]
                yield rows({"doc_id": part.column("doc_id").to_pylist(), "fingerprint": prints}, FINGERPRINT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint binary")


def _array(column: pa.ChunkedArray | pa.Array, lanes: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, ">u8").astype(U).reshape(-1, lanes)


def _binary(prints: np.ndarray) -> list[bytes]:
    data, n = prints.astype(">u8").tobytes(), 8 * prints.shape[1]
    return [data[i : i + n] for i in range(0, len(data), n)]


LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])
VISIT = pa.schema([("anchor", pa.int64()), ("home", pa.bool_()), ("fingerprint", pa.binary())])
#: Crowded anchors are broadcast up to this number, and joined by a shuffle beyond.
BROADCAST_ROWS = 10_000


def visits(prints: DataFrame, lanes: int, projections: list, threshold: int) -> DataFrame:
    """The anchors that each fingerprint goes to; with threshold 0 its homes only."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 5_000):
                of = batch.column("fingerprint").slice(at, 5_000)
                x = _array(of, lanes)
                for k, fields in enumerate(projections):
                    who, anchor, spent = anchors(x, fields, threshold)
                    anchor = (anchor | U(k << 2 * BITS)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(spent == 0), of.take(pa.array(who))], schema=VISIT)

    return prints.select("fingerprint").mapInArrow(run, "anchor long, home boolean, fingerprint binary")


def forest(x: np.ndarray, homes: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links that connect all rows of ``x`` which links to ``homes`` connect."""
    group, a, b = np.arange(len(x)), [], []
    for i in homes.tolist():
        hits = np.flatnonzero(near(x ^ x[i]))
        hits = hits[group[hits] != group[i]]
        if len(hits):
            others, first = np.unique(group[hits], return_index=True)
            a.append(np.full(len(first), i))
            b.append(hits[first])
            group[np.isin(group, others)] = group[i]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def joined(known: dict[bytes, bytes], a: bytes, b: bytes) -> bool:
    """Put two fingerprints in one group of ``known``; false if they are already."""

    def root(x: bytes) -> bytes:
        while (up := known.setdefault(x, x)) != x:
            known[x] = x = known[up]
        return x

    p, q = root(a), root(b)
    known[max(p, q)] = min(p, q)
    return p != q


def links(prints: DataFrame, lanes: int = 1, most: int = 2, projections: list | None = None, lane_most: int | None = None, threshold: int = 2, home: int = HOME) -> DataFrame:
    """Links that connect all pairs of fingerprints differing in at most ``most`` bits.

    ``prints`` has distinct fingerprints. Returned are, of the pairs met in each task, enough to
    connect what these pairs connect (a forest), so their number stays in proportion to the task's
    fingerprints whatever a group's size. ``lane_most``: a pair must also have a lane with so few.

    An anchor that is home to over ``home`` fingerprints is dealt to a grid: homes to its rows,
    visitors to its columns, each replicated along the other side, so that every pair still meets.
    """
    projections = projections or PAIR
    # A fingerprint becomes dozens of visits, so its partitions must not be as few as its bytes suggest.
    prints = prints.select("fingerprint").repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    went = visits(prints, lanes, projections, threshold)
    crowded = written(visits(prints, lanes, projections, 0).groupBy("anchor").count().filter(F.col("count") > home).select("anchor", F.ceil(F.col("count") / home).cast("int").alias("parts")), "crowded")
    if n := crowded.count():
        side = F.broadcast(crowded) if n <= BROADCAST_ROWS else crowded
        met = went.join(side, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        met = met.withColumn("home", F.explode(F.when(F.col("home") & (F.col("parts") > 1), F.array(F.lit(True), F.lit(False))).otherwise(F.array("home"))))
        own, along = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
        cells = F.when(F.col("home"), F.transform(along, lambda q: own * F.col("parts") + q)).otherwise(F.transform(along, lambda p: p * F.col("parts") + own))
        met = met.select("anchor", F.explode(cells).alias("part"), "home", "fingerprint")
    else:
        met = went.select("anchor", F.lit(0).alias("part"), "home", "fingerprint")

    def near(differ: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(differ)
        close = apart.sum(1) <= most
        return close if lane_most is None else close & (apart.min(1) <= lane_most)

    def compare(batches):
        """Rows come ordered by anchor; the last anchor of a batch waits for the next batch. Links
        of what the task has already connected, at whatever anchor, are left out."""
        left, last, known = [], None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in ("anchor", "part")]
            edge = np.flatnonzero(np.append((key[0][0], key[1][0]) != last, np.logical_or.reduce([k[1:] != k[:-1] for k in key])))
            last = key[0][-1], key[1][-1]
            if len(edge):
                done = pa.Table.from_batches([*left, batch.slice(0, edge[-1])], batch.schema).combine_chunks()
                if done.num_rows:
                    before = done.num_rows - edge[-1]
                    yield from found(done, np.unique(np.concatenate([[0], edge + before])), known)
                left = [batch.slice(edge[-1])]
            else:
                left.append(batch)
            if len(known) > KNOWN:  # links are given twice rather than remembered without end
                known.clear()
        if left:
            table = pa.Table.from_batches(left).combine_chunks()
            yield from found(table, np.array([0, table.num_rows]), known)

    def found(table: pa.Table, edge: np.ndarray, known: dict[bytes, bytes]):
        home = table.column("home").to_numpy(zero_copy_only=False)
        group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        homes = np.bincount(group[home], minlength=len(edge) - 1)
        x = _array(table.column("fingerprint"), lanes)
        # Anchors with one home, the most: all at once.
        first = np.zeros(len(edge) - 1, np.int64)
        first[group[home]] = np.flatnonzero(home)
        rows_ = np.flatnonzero(homes[group] == 1)
        rows_ = rows_[near(x[rows_] ^ x[first[group[rows_]]])]
        a, b = [first[group[rows_]]], [rows_]
        for g in np.flatnonzero((homes > 1) & (np.diff(edge) > 1)).tolist():
            s, e = int(edge[g]), int(edge[g + 1])
            p, q = forest(x[s:e], np.flatnonzero(home[s:e]), near)
            a.append(p + s)
            b.append(q + s)
        a, b = np.concatenate(a), np.concatenate(b)
        a, b = (y[(x[a] != x[b]).any(1)] for y in (a, b))
        new = [(p, q) for p, q in zip(_binary(x[a]), _binary(x[b])) if joined(known, p, q)]
        if new:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in new], pa.binary()), pa.array([q for _, q in new], pa.binary())], schema=LINK)

    dealt = met.repartition(F.col("anchor"), F.col("part")).sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(compare, "a binary, b binary").distinct()


def simhash_near_duplicates(docs: DataFrame, shingle: int = 3, lanes: int = 1, **linking) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id: the smallest doc_id reachable over links.

    ``docs`` has doc_id and text; other columns are ignored. A-Z are lower-cased; a word is a run of
    characters other than space and \\t..\\r; a shingle is ``shingle`` words joined by spaces, repeats
    included; fewer words make one shingle. A bit is 1 if over half of the shingles' hashes have
    it. Defined cases: a null or empty text, or one without words, has fingerprint zero and is
    linked like any other; repeated rows each give a row; a row whose doc_id is null is linked, too,
    but gives no component its id (a component of such rows alone has a null id); texts are read whole,
    however long; an empty table gives an empty result. Copies meet only as one fingerprint, however many there are.
    """
    prints = written(fingerprints(docs, shingle, lanes), "fingerprints")
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    parts = connected_components(links(distinct, lanes, **linking))
    linked = parts.join(distinct, parts["node"] == distinct["fingerprint"]).select("component", "fingerprint", "first")
    smallest = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    named = linked.join(smallest, "component").select("fingerprint", "component_id")
    # Written, so that the last join has plain scans on both sides, and a fingerprint of many copies
    # can be split over tasks.
    of = written(distinct.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "first").alias("component_id")), "components")
    return prints.join(of, "fingerprint").select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")
