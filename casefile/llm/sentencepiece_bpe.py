"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

The vocabulary and scores come from a model file, whose path is a parameter. A batch of texts is one
array of bytes; its words (a run of spaces, then other characters) are told apart by hashes, and
those that the worker has not met are encoded together: their symbols lie in flat numpy arrays, and
each round merges, in all words at once, the pair of the best rank (the leftmost, or all its leftmost
non-overlapping occurrences where that provably gives the same), then compacts the arrays, until no
word has a pair left. Very long words are merged at all places at once whose pair is the best one
as far as any piece reaches (``far``). Ids, their decimals and their text are gathered for whole batches.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casefile.llm.common import pieces, rows
from casefile.llm.word_ids import WordIds

SPACE = "▁"
LITERAL = SPACE.encode()
#: Symbols of a word from which on it counts as very long.
LONG = 200
#: Bytes of text in a batch; ids that are turned to text or decimals at a time.
BATCH, GATHER = 1 << 21, 1 << 17
NONE = np.int32((1 << 31) - 1)


class Bpe:
    """Tables of a model's BPE: encode() gives the ids of words, decode() the text of ids."""

    def __init__(self, path: str):
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        self.eos, self.unk = m.eos_id(), m.unk_id()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in usual}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece of this vocabulary crosses the beginning of a word")
        self.byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        score = {p: m.get_score(i) for p, i in self.ids.items()}
        levels = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {p: levels[s] for p, s in score.items()}
        shared = {s for s, n_ in Counter(score.values()).items() if n_ > 1}
        # Symbols beyond the vocabulary are numbered from n on, by code point.
        self.first = n
        self.rank = np.full(n, NONE, np.int32)
        unsafe = set()
        for p, r in rank.items():
            self.rank[self.ids[p]] = r
            if score[p] in shared:
                unsafe.add(p)
            for k in range(2, len(p)):
                unsafe |= {t for t in (p[:k], p[-k:]) if rank.get(t, -1) > r}
        self.safe = np.ones(n, bool)
        self.safe[[self.ids[p] for p in unsafe]] = False
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if p[:k] in self.ids and p[k:] in self.ids:
                    pairs[self.ids[p[:k]] << 32 | self.ids[p[k:]]] = i
        # A pair's key is found by a multiplicative hash and few probes.
        self.places = 1 << max(16, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(self.places + 64, -1, np.int64), np.full(self.places + 64, -1, np.int32)
        self.probes = 1
        for key, value in pairs.items():
            at = int(self.place(np.array([key], np.int64))[0])
            k = 0
            while self.keys[at + k] >= 0:
                k += 1
            self.keys[at + k], self.values[at + k] = key, value
            self.probes = max(self.probes, k + 1)
        #: The number of each code point's symbol, and how many code points a piece has at most.
        self.symbol = n + np.arange(0x110000, dtype=np.int32)
        for p in self.ids:
            if len(p) == 1:
                self.symbol[ord(p)] = self.ids[p]
        self.symbol[32] = self.symbol[ord(SPACE)]
        self.longest = max(map(len, self.ids))
        self.known = WordIds([self.eos], self.merge)
        self.is_byte, self.silent = np.zeros(n, bool), np.array([m.is_control(i) for i in range(n)])
        self.is_byte[self.byte] = True
        self.plain = ["" if self.silent[i] else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.plain[self.unk] = " ⁇ "
        self.spaced = np.array([p.startswith(SPACE) for p in self.pieces])
        data = [p.encode() for p in self.plain]
        for b, i in enumerate(self.byte):
            data[i] = bytes([b])
        self.text, self.decimal = Strings(data), Strings([b"%d " % i for i in range(n)])

    def place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - self.places.bit_length())).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make together, or -1."""
        key = left.astype(np.int64) << 32 | right
        at, out = self.place(key), np.full(len(key), -1, np.int32)
        todo = np.arange(len(key))
        for k in range(self.probes):
            there = self.keys[at + k]
            hit = there == key
            out[todo[hit]] = self.values[at[hit] + k]
            go = ~hit & (there >= 0)  # an empty place ends the search
            if not go.any():
                break
            todo, at, key = todo[go], at[go], key[go]
        return out

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in one array, and where each word's end, without any cache."""
        data = [w.replace(SPACE, " ").encode() for w in words]
        return self.merge(np.frombuffer(b"".join(data), np.uint8), np.array([len(d) for d in data]))

    def merge(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (of ``size`` bytes each) in one array, and where each word's end."""
        n = len(size)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        chars = np.diff(chars[np.append(0, np.cumsum(size))])
        sym, word = self.symbol[points], np.repeat(np.arange(n, dtype=np.int32), chars)
        if (long := chars > LONG).any():
            out = long[word]
            far_sym, far_word = self.far(sym[out], word[out])
            sym, word = self.near(sym[~out], word[~out])
            sym, word = np.concatenate([sym, far_sym]), np.concatenate([word, far_word])
            order = np.argsort(word, kind="stable")
            sym, word = sym[order], word[order]
        else:
            sym, word = self.near(sym, word)
        if len(odd := np.flatnonzero(sym >= self.first)):  # characters without a piece become their bytes
            data = [chr(c).encode() for c in (sym[odd] - self.first).tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(x) for x in data]
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            sym[sym >= self.first] = np.array(self.byte)[np.frombuffer(b"".join(data), np.uint8)]
        return sym.astype(np.uint32), np.cumsum(np.bincount(word, minlength=n))

    def far(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges very long words. A pair that is the best within ``longest`` symbols to either side
        merges at once: whatever merges before it in the order of ranks begins beyond these symbols,
        and no piece reaches over them. Equally good pairs so near each other form a chain, which
        merges from its first on, every second one where they overlap; a chain with an equal before
        it waits, and it stops behind a merge that makes a pair as good or better."""
        steps = (self.longest - 1).bit_length()
        reach = 1 << steps
        pair = self.pairs(sym, word, np.arange(len(sym)))
        rank = np.where(pair >= 0, self.rank[pair], NONE)
        while True:
            least = np.full(len(rank) + 2 * reach + 1, NONE, np.int32)
            least[reach : reach + len(rank)] = rank
            for k in range(steps):  # of each place: the best of it and the reach - 1 after it
                np.minimum(least[: -(1 << k)], least[1 << k :], out=least[: -(1 << k)])
            before, after = least[: len(rank)], least[reach + 1 : reach + 1 + len(rank)]
            hit = np.flatnonzero((rank != NONE) & (rank <= before) & (rank <= after))
            if not len(hit):
                return sym, word
            new = np.append(True, np.diff(hit) > reach)
            chain = np.cumsum(new) - 1
            go = (rank[hit[new]] < before[hit[new]])[chain]
            hit, chain = hit[go], chain[go]
            run = np.append(True, np.diff(hit) > 1)
            even = (np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0
            hit, chain = hit[even], chain[even]
            if not self.safe[pair[hit]].all():
                bad = self.overtaken(sym, word, pair, rank, hit)
                so_far = np.cumsum(bad) - bad
                hit = hit[so_far == so_far[np.searchsorted(chain, chain)]]
            sym[hit] = pair[hit]
            keep, fresh = np.ones(len(sym), bool), np.zeros(len(sym), bool)
            keep[hit + 1] = False
            fresh[hit] = True
            sym, word, pair, rank, fresh = (x[keep] for x in (sym, word, pair, rank, fresh))
            fresh[:-1] |= fresh[1:]
            beside = np.flatnonzero(fresh)
            got = self.pairs(sym, word, beside)
            pair[beside] = got
            rank[beside] = np.where(got >= 0, self.rank[got], NONE)

    def overtaken(self, sym: np.ndarray, word: np.ndarray, pair: np.ndarray, rank: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Which merges, in their order, make a pair with a neighbour that is as good or better."""
        piece, bad = pair[hit], np.zeros(len(hit), bool)
        merged = np.append(False, np.diff(hit) == 2)
        for at, left in ((hit - 1, True), (hit + 2, False)):
            can = np.flatnonzero((at >= 0) & (at < len(sym)))
            near = sym[at[can]]
            if left:  # the merge before this one has been made
                near = np.where(merged[can], pair[hit[can] - 2], near)
            usual = (word[at[can]] == word[hit[can]]) & (near < self.first)
            can, near = can[usual], near[usual]
            got = self.merged(near, piece[can]) if left else self.merged(piece[can], near)
            bad[can] |= (got >= 0) & (self.rank[got] <= rank[hit[can]])
        return bad

    def near(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges words, in each of them the best pair a round."""
        done_sym, done_word, done_at = [], [], []
        at = np.arange(len(sym), dtype=np.int32)
        pair = self.pairs(sym, word, np.arange(len(sym)))
        rank = np.where(pair >= 0, self.rank[pair], NONE)
        while len(sym):
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(word)))
            over = best == NONE
            if over.any():  # words without a pair leave
                out = np.repeat(over, size)
                done_sym.append(sym[out])
                done_word.append(word[out])
                done_at.append(at[out])
                sym, word, at, pair, rank = (x[~out] for x in (sym, word, at, pair, rank))
                best, size = best[~over], size[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            # Of a run of overlapping hits every second one merges, from the left; a word whose
            # pair is not safe, or has equals in rank, merges its leftmost only.
            run = np.append(True, np.diff(hit) > 1)
            nth = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            leftmost = np.append(True, word[hit[1:]] != word[hit[:-1]])
            hit = hit[np.where(self.safe[pair[hit]], nth % 2 == 0, leftmost)]
            sym[hit] = pair[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            # Only pairs beside a merge are new.
            fresh = np.zeros(len(sym), bool)
            fresh[hit] = True
            sym, word, at, pair, rank, fresh = (x[keep] for x in (sym, word, at, pair, rank, fresh))
            fresh[:-1] |= fresh[1:]
            beside = np.flatnonzero(fresh)
            got = self.pairs(sym, word, beside)
            pair[beside] = got
            rank[beside] = np.where(got >= 0, self.rank[got], NONE)
        sym, word, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_word, done_at))
        order = np.argsort(at)
        return sym[order], word[order]

    def pairs(self, sym: np.ndarray, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The piece that symbol i and the next of its word make together, or -1."""
        out = np.full(len(i), -1, np.int32)
        can = np.flatnonzero(i + 1 < len(sym)) if len(i) and i[-1] + 1 >= len(sym) else np.arange(len(i))
        a, b = sym[i[can]], sym[i[can] + 1]
        usual = (word[i[can]] == word[i[can] + 1]) & (a < self.first) & (b < self.first)
        out[can[usual]] = self.merged(a[usual], b[usual])
        return out

    def ids_of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts (UTF-8) in one array, each with the end id, and where each text's end."""
        texts = [b" " + t.replace(LITERAL, b" ") if t else t for t in texts]
        size = np.array([len(t) for t in texts], np.int64)
        data, end = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size)
        begins = data == 32
        begins[1:] &= data[:-1] != 32
        begins[(end - size)[size > 0]] = True
        start = np.flatnonzero(begins)
        which = self.known.of(data, start, np.append(start[1:], len(data))[: len(start)])
        # The end id stands behind the words of each text, as a word that is always known.
        which = np.insert(which, np.searchsorted(start, end), 0)
        ids, after = self.known.join(which)
        return ids, after[np.flatnonzero(which == 0)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, with the end id."""
        ids, end = self.ids_of([t.encode() for t in texts])
        return np.split(ids, end[:-1])

    def texts_of(self, ids: np.ndarray, end: np.ndarray) -> list[bytes]:
        """The texts of documents' ids, decoded together. Those with ids of single bytes, which need
        not be UTF-8 together, or beginning with a silent id are decoded one by one."""
        odd, out, begin = self.is_byte[ids], [], 0
        odd = np.append(0, np.cumsum(odd))
        for whole, stops in gathered(self.text, ids, end):
            at = 0
            for stop in stops:
                to = int(end[len(out)])
                if begin == to or odd[to] > odd[begin] or self.silent[ids[begin]]:
                    out.append(self.decode_bytes(ids[begin:to]))
                else:
                    out.append(whole[at + bool(self.spaced[ids[begin]]) : stop])
                at, begin = stop, to
        return out

    def decimals_of(self, ids: np.ndarray, end: np.ndarray) -> list[bytes]:
        """Documents' ids in decimal, joined by spaces."""
        out = []
        for whole, stops in gathered(self.decimal, ids, end):
            out += [whole[a : b - 1] if b > a else b"" for a, b in zip([0, *stops], stops)]
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids: their pieces' bytes joined by one gather, spaces restored and the
        first one dropped. Bytes that are no UTF-8 become U+FFFD each."""
        if not len(ids):
            return b""
        data = self.text.join(ids)[0].tobytes()
        if self.is_byte[ids].any():
            try:
                data.decode()
            except UnicodeDecodeError:
                return self.careful(ids.tolist()).encode()
        loud = np.flatnonzero(~self.silent[ids[:8]])
        first = ids[loud[0]] if len(loud) else next((i for i in ids.tolist() if not self.silent[i]), None)
        return data[1:] if first is not None and self.spaced[first] else data

    def careful(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            if self.is_byte[i]:
                run.append(self.byte.index(i))
            else:
                out += [utf8(bytes(run)), self.plain[i]]
                run.clear()
        text = "".join([*out, utf8(bytes(run))])
        first = next((i for i in ids if not self.silent[i]), None)
        return text[1:] if first is not None and self.spaced[first] else text

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode()


class Strings:
    """Byte strings by number, joined by one gather."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(x) for x in strings], np.int32)
        self.at = (np.cumsum(self.size) - self.size).astype(np.int32)

    def join(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The joined strings, and where each ends."""
        n = self.size[numbers]
        end = np.cumsum(n)
        return self.data[np.repeat(self.at[numbers] - end + n, n) + np.arange(end[-1] if len(end) else 0)], end


def gathered(strings: Strings, ids: np.ndarray, end: np.ndarray):
    """Documents' ids as strings: some documents at a time, with the ends of each. A very long
    document comes alone, gathered in parts."""
    begin = done = 0
    while done < len(end):
        more = max(done + 1, int(np.searchsorted(end, begin + GATHER, side="right")))
        stop, parts, ends = int(end[more - 1]), [], [np.zeros(1, np.int64)]
        for a in range(begin, stop, GATHER):
            data, at = strings.join(ids[a : min(a + GATHER, stop)])
            parts.append(data.tobytes())
            ends.append(at + ends[-1][-1])
        ends = np.concatenate([ends[0], *ends[1:]])
        yield b"".join(parts), ends[end[done:more] - begin].tolist()
        begin, done = stop, more


def utf8(data: bytes) -> str:
    """Each byte that is not part of valid UTF-8 becomes one U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[k : k + n].decode())
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


@functools.cache
def bpe(path: str) -> Bpe:
    """The model's tables, once in a worker process."""
    return Bpe(path)


def utf8_of(column: pa.Array) -> list[bytes]:
    """Whole texts in UTF-8; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def sentencepiece_encode(docs: DataFrame, model: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with a column ``out``: the ids of each whole ``text``, with the end id, as an array;
    and, if ``decoded`` names one, a column with the text that these ids decode to.

    Null and empty texts have the end id only. Other columns stay as they are; one already named
    ``out`` is replaced. ``model`` is a path that exists on every executor.
    """
    df = docs.drop(out, *([decoded] if decoded else []))
    fields = df.schema.names
    schema = T.StructType(list(df.schema.fields)).add(out, T.ArrayType(T.IntegerType()))
    if decoded:
        schema = schema.add(decoded, T.StringType())
    at = fields.index(text)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text, BATCH):
                ids, end = bpe(model).ids_of(utf8_of(part.column(at)))
                columns = [*part.columns, pa.ListArray.from_arrays(np.append(0, end).astype(np.int32), ids.view(np.int32))]
                if decoded:
                    columns.append(pa.array(bpe(model).texts_of(ids, end), pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def sentencepiece_decode(encoded: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with a column ``out``: the text of each ``ids``; null ids have an empty text."""
    df = encoded.drop(out)
    fields = df.schema.names
    schema = T.StructType(list(df.schema.fields)).add(out, T.StringType())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [bpe(model).decode(np.array(x.values) if x.is_valid else np.zeros(0, np.int32)) for x in part.column(fields.index(ids))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())], names=[*fields, out])

    return df.mapInArrow(run, schema)


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def sentencepiece_digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded text of each whole text; ids and text are
    made and dropped batch by batch, so that they are never shuffled or stored."""

    def run(batches):
        coder = bpe(model)
        for batch in batches:
            for part in pieces(batch, "text", BATCH):
                ids, end = coder.ids_of(utf8_of(part.column("text")))
                yield rows({
                    "doc_id": part.column("doc_id").to_pylist(),
                    "n_tokens": np.diff(end, prepend=0).tolist(),
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in coder.decimals_of(ids, end)],
                    "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in coder.texts_of(ids, end)],
                }, DIGEST)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
