"""Matroska media columns: a small writer, and a parser of EBML elements, clusters, lacing and cues.

``matroska_packets`` turns a binary column into a table of packets with track, timestamp and byte
range. ``with_matroska`` stores bytes losslessly as 8-bit PCM of one track.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.llm.common import pieces, rows, written

# Element ids of the Matroska specification (fixed values).
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, GROUP, BLOCK, CUES, CUE, CUE_AT = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x1C53BB6B, 0xBB, 0xB7
SCALE, DURATION, NUMBER, UID, KIND, CODEC, LACING, RATE, CHANNELS, DEPTH = 0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xB5, 0x9F, 0x6264
DOCTYPE, CUE_TIME, CUE_TRACK, CUE_CLUSTER, REFERENCE, FRAME_NS = 0x4282, 0xB3, 0xF7, 0xF1, 0xFB, 0x23E383
MASTERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT, EBML}
#: Elements that end a cluster (or, inside it, an element) of unknown size.
TOP = {CLUSTER, CUES, INFO, TRACKS}
NO_LACING, XIPH, FIXED, EBML_LACING = range(4)
SAMPLE_RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 64


def element(id_: int, data: bytes) -> bytes:
    n = len(data)
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + (n | 1 << 7 * width).to_bytes(width, "big") + data


def number(id_: int, value: int) -> bytes:
    return element(id_, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


HEAD = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOCTYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
TRACK_HEAD = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + number(FRAME_NS, FRAME * 1_000_000_000 // SAMPLE_RATE) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))))


def vint(value: int) -> bytes:
    width = next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def signed_vint(value: int) -> bytes:
    width = next(w for w in range(1, 9) if abs(value) < (1 << 7 * w - 1) - 1)
    return (value + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")


def laced(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing kind and the block's data; sizes that differ are written as EBML lacing."""
    if len(frames) == 1:
        return NO_LACING, frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return FIXED, bytes([len(frames) - 1]) + b"".join(frames)
    head = vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1]))
    return EBML_LACING, bytes([len(frames) - 1]) + head + b"".join(frames)


def written_media(payload: bytes) -> bytes:
    """``payload`` as 8-bit samples: frames of FRAME bytes, LACED of them in a block, BLOCKS blocks
    in a cluster, a cue for each cluster. The bytes depend on the payload only."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)) + element(0x4D80, b"casefile") + element(0x5741, b"casefile"))
    body, cues = info + TRACK_HEAD, b""
    for c in range(0, len(frames), LACED * BLOCKS):
        at = c * FRAME * 1000 // SAMPLE_RATE
        blocks = []
        for b in range(c, min(len(frames), c + LACED * BLOCKS), LACED):
            kind, data = laced(frames[b : b + LACED])
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", b * FRAME * 1000 // SAMPLE_RATE - at) + bytes([0x80 | kind << 1]) + data))
        cues += element(CUE, number(CUE_TIME, at) + element(CUE_AT, number(CUE_TRACK, 1) + number(CUE_CLUSTER, len(body))))
        body += element(CLUSTER, number(TIMESTAMP, at) + b"".join(blocks))
    return HEAD + element(SEGMENT, body + element(CUES, cues))


def head(data: bytes, at: int) -> tuple[int, int, int]:
    """An element's id, its data's offset, and its size (-1: unknown)."""
    first = data[at]
    width = 9 - first.bit_length()
    id_ = int.from_bytes(data[at : at + width], "big")
    at += width
    value, at = read_vint(data, at)
    return id_, at, value


def read_vint(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length number (-1 if all its bits are 1, which means unknown) and where it ends."""
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("a damaged number")
    bits = (1 << 7 * width) - 1
    value = int.from_bytes(data[at : at + width], "big") & bits
    return (-1 if value == bits else value), at + width


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[int, list[int]]:
    """Where a block's frames begin, and their sizes."""
    if kind == NO_LACING:
        return at, [end - at]
    n, at = data[at] + 1, at + 1
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError("frames of unequal size")
        return at, [(end - at) // n] * n
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        size, at = read_vint(data, at) if n > 1 else (0, at)
        sizes = [size] if n > 1 else []
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            value, at = read_vint(data, at)
            if value < 0:
                value = (1 << 7 * width) - 1
            sizes.append(sizes[-1] + value - (1 << 7 * width - 1) + 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames beyond their block")
    return at, sizes


class Media:
    """What a Matroska file says: tracks, packets (track, timestamp in ns, offset, size, key frame,
    lacing), cues (time, track, offset in the segment), duration and time scale.

    With ``since`` (ns), packets begin with the cluster that the last cue up to that time points at;
    clusters before it are passed over by their sizes."""

    def __init__(self, data: bytes, since: int | None = None):
        self.skip, self.passed = since is not None, []
        self.tracks: list[dict] = []
        self.packets: list[tuple[int, int, int, int, bool, int]] = []
        self.cues: list[tuple[int, int, int]] = []
        self.scale, self.duration, self.clusters, self.error = 1_000_000, 0.0, [], None
        self.cluster = 0
        try:
            if not data or head(data, 0)[0] != EBML:
                raise ValueError("no EBML header")
            self.walk(data, 0, len(data), 0)
            if self.skip:
                self.skip = False
                begin = max((c for t, _, c in self.cues if t * self.scale <= since), default=0)
                for at, end in self.passed:
                    if at - self.segment >= begin:
                        self.walk(data, at, end, SEGMENT)
        except (ValueError, IndexError, struct.error) as e:
            self.error = str(e) or type(e).__name__
        # Frames of one block follow each other by their track's frame duration, if it says one.
        step = {t.get(NUMBER): t.get(FRAME_NS, 0) for t in self.tracks}
        self.packets = [(t, at * self.scale + nth * step.get(t, 0), *rest) for t, at, *rest, nth in self.packets]

    def walk(self, data: bytes, at: int, end: int, inside: int) -> int:
        """Read elements up to ``end``; returns where an element of unknown size ends."""
        while at < end:
            start = at
            id_, at, size = head(data, at)
            if size < 0 and id_ not in (SEGMENT, CLUSTER):
                raise ValueError("an element without a size")
            if inside == CLUSTER and id_ in TOP:
                return start
            stop = end if size < 0 else at + size
            if stop > end:
                raise ValueError("an element beyond its parent")
            if id_ == SEGMENT:
                self.segment = at
            if id_ == CLUSTER and self.skip and size >= 0:
                self.passed.append((start, stop))
                at = stop
                continue
            if id_ == CLUSTER:
                self.clusters.append(start - self.segment)
            if id_ == GROUP:
                group, self.refers = len(self.packets), False
            if id_ == TRACK:
                self.tracks.append({})
            if id_ == CUE:
                self.cue = {}
            if id_ in MASTERS:
                at = self.walk(data, at, stop, id_)
                if id_ == GROUP and self.refers:  # it needs another frame
                    self.packets[group:] = [(*x[:4], False, *x[5:]) for x in self.packets[group:]]
                if id_ == CUE:
                    self.cues.append(tuple(self.cue.get(k, 0) for k in (CUE_TIME, CUE_TRACK, CUE_CLUSTER)))
                continue
            if id_ in (SIMPLE_BLOCK, BLOCK):
                self.block(data, at, stop, id_ == SIMPLE_BLOCK)
            elif id_ == REFERENCE and inside == GROUP:
                self.refers = True
            elif id_ == TIMESTAMP:
                self.cluster = int.from_bytes(data[at:stop], "big")
            elif id_ == SCALE:
                self.scale = int.from_bytes(data[at:stop], "big")
            elif id_ == DURATION:
                self.duration = struct.unpack(">f" if size == 4 else ">d", data[at:stop])[0]
            elif inside in (TRACK, AUDIO):
                value = data[at:stop]
                self.tracks[-1][id_] = value.decode("ascii", "replace") if id_ == CODEC else struct.unpack(">f" if size == 4 else ">d", value)[0] if id_ == RATE else int.from_bytes(value, "big")
            elif inside in (CUE, CUE_AT):
                self.cue[id_] = int.from_bytes(data[at:stop], "big")
            at = stop
        return at

    def block(self, data: bytes, at: int, end: int, simple: bool) -> None:
        track, at = read_vint(data, at)
        (relative,) = struct.unpack_from(">h", data, at)
        flags = data[at + 2]
        at, sizes = lace_sizes(data, at + 3, end, flags >> 1 & 3)
        for nth, size in enumerate(sizes):
            self.packets.append((track, self.cluster + relative, at, size, bool(flags & 0x80) if simple else True, flags >> 1 & 3, nth))
            at += size


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[p[2] : p[2] + p[3]] for p in media.packets if p[0] == track)


def with_matroska(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of every whole text: its UTF-8 with zero bytes up to a positive
    multiple of 64, as samples. Null is an empty text. Other columns are ignored."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = [(t.as_py() or "").encode() for t in part.column("text")]
                yield rows({"doc_id": part.column("doc_id").to_pylist(), "n_bytes": [len(t) for t in texts], "media": [written_media(t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))) for t in texts]}, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


PACKET = pa.schema([("doc_id", pa.int64()), ("packet", pa.int64()), ("track", pa.int32()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("key_frame", pa.bool_()), ("lacing", pa.int32()), ("cue", pa.bool_())])


def matroska_packets(media: DataFrame, since_ns: int | None = None) -> DataFrame:
    """One row for each packet of each ``media`` (with doc_id): its number, track, timestamp, byte
    range and lacing, and whether a cue points at its time. A null, empty or damaged file gives the
    packets before the damage; see ``matroska_errors``. With ``since_ns`` only the packets from the
    cluster on to which the cues lead for that time, numbered from there. Files are read whole, however long."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "media"):
                out: dict[str, list] = {f.name: [] for f in PACKET}
                for doc, data in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist()):
                    found = Media(data or b"", since_ns)
                    cued = {t * found.scale for t, _, _ in found.cues}
                    for k, p in enumerate(found.packets):
                        for name, value in zip(out, (doc, k, *p, p[1] in cued)):
                            out[name].append(value)
                yield rows(out, PACKET)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, packet long, track int, timestamp_ns long, offset long, size long, key_frame boolean, lacing int, cue boolean")


def matroska_errors(media: DataFrame) -> DataFrame:
    """doc_id and error (null if the file reads well) of each ``media``."""
    schema = pa.schema([("doc_id", pa.int64()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "media"):
                yield rows({"doc_id": part.column("doc_id").to_pylist(), "error": [Media(m or b"").error for m in part.column("media").to_pylist()]}, schema)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, error string")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def feature(payload: bytes, media: Media) -> str:
    """Facts of the container and of its samples."""
    x = np.frombuffer(payload, np.uint8)
    track = media.tracks[0] if media.tracks else {}
    ends = max((p[1] for p in media.packets), default=0) // 1_000_000
    return f"codec={track.get(CODEC)};rate={track.get(RATE, 0):g};bits={track.get(DEPTH)};packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};last_ms={ends};sum={int(x.sum(dtype=np.int64))};peak={int(x.max(initial=0))};crossings={int(np.count_nonzero((x[1:] > 127) != (x[:-1] > 127)))}"


def matroska_digest(docs: DataFrame) -> DataFrame:
    """Store each whole text as Matroska in the shared folder, read the stored bytes back, and
    return what they hold. Null and empty texts are 64 zero bytes. Repeated rows each give a row, equal
    texts equal values; texts are stored whole, however long; an empty table gives an empty result."""
    stored = written(with_matroska(docs), "matroska")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "media"):
                out: dict[str, list] = {f.name: [] for f in DIGEST}
                for doc, n, data in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                    media = Media(data)
                    if media.error:
                        raise ValueError(f"document {doc}: {media.error}")
                    payload = payload_of(data, media)
                    values = doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, media)
                    for name, value in zip(out, values):
                        out[name].append(value)
                yield rows(out, DIGEST)

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
