"""Personal data: base matches, and spans that boosted trees choose among candidates.

1. Base matches are leftmost matches of four patterns that pass a check (part sizes, Luhn, number of digits). All are found in
   time linear in the text: e-mails from each @, the others inside zones of digits and their signs.
2. Generators propose overlapping candidates of high recall: every stretch of groups of digits whose number of digits could be a
   phone's or a card's, every four dotted groups, every local part and domain around an @ or a written-out one. A base pattern
   takes the longest run, so a number next to another one is missed; its candidate is not.
3. Labels come from the base matches: a candidate that is one is positive; one inside a failed base match may be either and is left out;
   any other is negative. Trees are fitted for each kind on format and context, on a sample bounded by SAMPLE rows a label;
   scores are calibrated on held-out rows of the sample, weighted by the corpus's counts.
4. Candidates clear of base matches are taken by calibrated probability, the highest first, down to PROBABILITY.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.llm.boosting import Steps, Trees, calibrated, fitted
from casefile.llm.common import pieces, written

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
#: Labelled candidates of each kind and label that trees are fitted on, and how sure an added span must be.
SAMPLE, PROBABILITY = 5_000, 0.95
#: With fewer positive or negative labels than this a kind has no trees and adds nothing.
FEWEST = 20
#: Signs of context on either side; candidates judged at a time.
CONTEXT, BLOCK = 32, 4_096

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOOSE_DOMAIN = re.compile(r"[^\W_](?:[\w-]|\.(?=\w))*+")
_WRITTEN_AT = re.compile(r" ?[\[({] ?at ?[\])}] ?", re.I)
_WRITTEN_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?: ?[\[({] ?dot ?[\])}] ?|\.)[A-Za-z0-9-]++)++", re.I)
#: Digits and the signs that phones, cards and addresses have among them.
_ZONE = re.compile(r"[0-9+][0-9 ().+-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Between digits these join numbers; blanks do not, or no number next to another would look whole.
_SIGNS = frozenset("-.()+")
_GROUP = re.compile(r"[0-9]+")
_NO_DIGIT = re.compile(r"[^0-9]+")
_HINTS = [re.compile(p, re.I) for p in (r"mail|contact|write to|@", r"\bip\b|host|server|address|login", r"card|visa|credit|payment|account", r"\btel|phone|call|mobile|fax|\bcell|whatsapp")]

FEATURES = ["size", "digits", "groups", "first", "last", "longest", "shortest", "plus", "parens", "spaces", "dashes", "dots", "luhn", "parts", "left", "right", "goes_on", "comes_from", "hint", "lead"]


def luhn(digits: str) -> bool:
    d = np.frombuffer(digits.encode(), np.uint8).astype(np.int64) - 48
    double = d[-2::-2] * 2
    return bool((d[-1::-2].sum() + (double - 9 * (double > 9)).sum()) % 10 == 0)


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        low = found.end() if found else at + 1
        at = text.find("@", low)
    return out


def base(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of matches that pass, of those that fail, and the zones with digits enough for any."""
    passed, failed, zones = [(EMAIL, *s) for s in _emails(text)], [], []
    by: list[list] = [[], [], [], []]
    for zone in _ZONE.finditer(text):
        low, high = zone.span()
        if high - low < 7:
            continue
        zones.append((low, high))
        for m in _IP.finditer(text, low, high):
            by[IP].append((m.span(), all(map(_part, m[0].split(".")))))
        for m in _CARD.finditer(text, low, high):
            digits = _NO_DIGIT.sub("", m[0])
            if len(digits) > 1:
                by[CARD].append((m.span(), 16 <= len(digits) <= 19 and luhn(digits)))
        if "+" in zone[0]:
            for m in _PHONE.finditer(text, low, high):
                by[PHONE].append((m.span(), 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15))
    for kind in (IP, CARD, PHONE):
        for span, good in by[kind]:
            (passed if good else failed).append((kind, *span))
    return passed, failed, zones


def _numbers(text: str, low: int, high: int):
    """Candidates of a zone: stretches of its groups of digits."""
    groups = [m.span() for m in _GROUP.finditer(text, low, high)]
    for i, (start, end) in enumerate(groups):
        begin = start
        if begin > low and text[begin - 1] == "(":
            begin -= 1
        if begin > low and text[begin - 1] == "+":
            begin -= 1
        digits, j = 0, i
        cards = dotted = True
        while True:
            a, b = groups[j]
            digits += b - a
            dotted &= b - a <= 3
            if digits > 19:
                break
            if 13 <= digits and cards:
                yield CARD, start, b
            if 7 <= digits <= 15:
                yield PHONE, begin, b
            if j - i == 3 and dotted:
                yield IP, start, b
            j += 1
            if j == len(groups) or groups[j][0] - b > 3:
                break
            between = text[b : groups[j][0]]
            cards &= len(between) == 1 and between in " -."
            dotted &= between == "."


def _mails(text: str):
    at = text.find("@")
    while at >= 0:
        start = at
        while start and at - start < 64 and (text[start - 1] in _LOCAL or text[start - 1].isalnum()):
            start -= 1
        found = _LOOSE_DOMAIN.match(text, at + 1)
        if start < at and found:
            yield EMAIL, start, found.end()
        at = text.find("@", at + 1)
    for m in _WRITTEN_AT.finditer(text):
        start, low = m.start(), max(0, m.start() - 64)
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _WRITTEN_DOMAIN.match(text, m.end())
        if start < m.start() and found:
            yield EMAIL, start, found.end()


def _sort(c: str) -> int:
    return 0 if not c or c.isspace() else 3 if c.isdigit() else 2 if c.isalpha() else 1


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span = text[start:end]
    sizes = [b - a for a, b in (m.span() for m in _GROUP.finditer(span))] or [0]
    digits = _NO_DIGIT.sub("", span)
    if kind == EMAIL:
        sizes = [len(x) for x in span.rsplit("@", 1)[-1].split(".")]
    before, after = text[max(0, start - 2) : start], text[end : end + 2]
    return [
        len(span), len(digits), len(sizes), sizes[0], sizes[-1], max(sizes), min(sizes), span[0] == "+", span.count("("), span.count(" "), span.count("-"), span.count("."),
        len(digits) > 1 and luhn(digits), kind == IP and all(map(_part, span.split("."))), _sort(before[-1:]), _sort(after[:1]), after[:1] in _SIGNS and after[1:].isdigit(), before[1:] in _SIGNS and before[:1].isdigit(),
        bool(_HINTS[kind].search(text[max(0, start - CONTEXT) : start])), int(digits[0]) if digits else -1,
    ]


class Cover:
    """Spans, told by whether they meet another."""

    def __init__(self, spans):
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        self.most = []
        for _, e in self.spans:
            self.most.append(max(e, self.most[-1]) if self.most else e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, end - 1)
        return k > 0 and self.most[k - 1] > start


def candidates(text: str):
    """Base matches, and an iterator over candidates (kind, start, end, label): 1 is a base match, -1 meets a failed one of
    its kind or of a phone's and is clear of base matches, 0 is any other. Candidates are not held together."""
    passed, failed, zones = base(text)
    is_, wrong, cover = set(passed), set(failed), Cover([(s, e) for _, s, e in passed])
    lost = [Cover([(s, e) for k, s, e in failed if k in (kind, PHONE)]) for kind in range(4)]

    def each():
        for c in chain(_mails(text), *(_numbers(text, low, high) for low, high in zones)):
            yield (*c, 1 if c in is_ else 0 if c in wrong or cover.meets(*c[1:]) or not lost[c[0]].meets(*c[1:]) else -1)

    return passed, each(), cover


@dataclass
class Model:
    """Trees and calibration by kind; a kind without them adds nothing."""

    kinds: dict[int, tuple[Trees, Steps]]
    probability: float = PROBABILITY

    def added(self, text: str, found, cover: Cover) -> list[tuple[int, int, int]]:
        """Candidates that are taken: clear of base matches and of each other, the most probable first, then the longest.
        Candidates are judged by blocks, and only sure ones are held."""
        open_, sure = ((c[0], c[1], c[2]) for c in found if c[0] in self.kinds and not cover.meets(c[1], c[2])), []
        while block := list(islice(open_, BLOCK)):
            for kind, (trees, rate) in self.kinds.items():
                if own := [c for c in block if c[0] == kind]:
                    p = rate(trees.scores(np.array([features(text, *c) for c in own], np.float64)))
                    sure += [(-q, c[1] - c[2], c[1], kind, c[2]) for q, c in zip(p.tolist(), own) if q >= self.probability]
        out, starts, ends = [], [], {}
        for _, _, start, kind, end in sorted(sure):
            k = bisect_left(starts, end)
            if k == 0 or ends[starts[k - 1]] <= start:
                insort(starts, start)
                ends[start] = end
                out.append((kind, start, end))
        return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Trees from the labelled candidates of all whole texts, on ``sample`` of each kind and label at most: those whose
    hashes are smallest, whatever the partitions. A third of them are held out to calibrate."""

    def run(batches):
        schema = pa.schema([("kind", pa.int32()), ("label", pa.int32()), ("hash", pa.int64()), ("x", pa.list_(pa.float64()))])
        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        out = []
        for batch in batches:
            for part in pieces(batch, "text"):
                for text in part.column("text").to_pylist():
                    for kind, start, end, label in candidates(text)[1] if text else ():
                        if label >= 0:
                            near = text[max(0, start - CONTEXT) : end + CONTEXT].encode("utf-8", "surrogatepass")
                            out.append((kind, label, xxhash.xxh64_intdigest(near, kind) >> 1, [float(v) for v in features(text, kind, start, end)]))
                            if len(out) == BLOCK:
                                yield rows(out)
                                out = []
        if out:
            yield rows(out)

    labelled = written(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind int, label int, hash long, x array<double>"), "candidates")
    counts = {(r["kind"], r["label"]): r["n"] for r in labelled.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    kinds = {}
    for kind in range(4):
        n = [counts.get((kind, label), 0) for label in (0, 1)]
        if min(n) < FEWEST:
            continue
        rows = [r for label in (0, 1) for r in labelled.filter(f"kind = {kind} and label = {label}").orderBy("hash", "x").limit(sample).collect()]
        x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], np.float64)
        weight = np.where(y == 1, n[1] / min(n[1], sample), n[0] / min(n[0], sample))
        out = np.array([r["hash"] % 3 == 0 for r in rows])
        if len(set(y[out])) < 2 or len(set(y[~out])) < 2:
            continue
        trees = fitted(x[~out], y[~out], weight[~out] / weight[~out].mean())
        kinds[kind] = (trees, calibrated(trees.scores(x[out]), y[out], weight[out]))
    return Model(kinds)


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end by kind as listed, then start."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def found(text: str | None, model: Model) -> tuple[list, list]:
    """Base spans and added spans of a text."""
    if not text:
        return [], []
    passed, proposed, cover = candidates(text)
    return passed, model.added(text, proposed, cover)


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text and any other columns) with each span of ``text`` replaced by its kind in brackets; of spans that meet,
    which only base matches of several kinds do, the whole stretch becomes the kind of the first. Null texts stay null."""
    at = docs.columns.index("text")
    # mapInArrow resolves names anew, and does not find those with dots.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    fields = plain.columns

    def run(batches):
        for batch in batches:
            for part in pieces(batch, fields[at]):
                texts = []
                for text in part.column(at).to_pylist():
                    out, done = [], 0
                    for start, end, kind in sorted((s, e, k) for spans in found(text, model) for k, s, e in spans):
                        if start >= done:
                            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
                        done = max(done, end)
                    texts.append(text if not done else "".join([*out, text[done:]]))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(len(fields))], names=fields)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans (base and added) of every document.

    ``docs`` has doc_id and text; other columns take no part. Null and empty texts have no spans. Texts are read whole,
    in linear time. Each row is judged alone, so repeated rows and shared or null doc_ids are rows of their own; an empty table
    gives an empty result. Base matches that fail their check are dropped without a retry; candidates may find what they hid."""
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    passed, more = found(text, model)
                    out.append((doc_id, *[sum(p[0] == k for p in passed) for k in range(4)], hashlib.sha256(joined(passed).encode()).hexdigest(), joined(passed + more), len(more)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)
