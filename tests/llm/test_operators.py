"""Each training-data operator against brute force on small tables, with the odd cases."""

import collections
import hashlib
import itertools
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casefile.llm import balltree, html_template, huffman, language_id, matroska, mixing, queries, sentencepiece_bpe, simhash, substring_dedup, url_graph
from casefile.llm.common import WORD_LETTERS, span_hashes
from casefile.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk int, part string, shard string, size string"


def documents(spark, rows):
    """Rows of (doc_id, text, source), with columns whose names the operators also use."""
    return spark.createDataFrame([(i, t, "en" if k % 2 else "fr", s, len(t or ""), k, "x", "y", "z") for k, (i, t, s) in enumerate(rows)], DOCS)


def words(n, seed, vocabulary=50):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}é" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    base = words(120, 1)
    shared = words(50, 2, 5000)
    out = [(1, " ".join(base), "a"), (2, " ".join(base), "b"), (3, None, None), (4, "", "a"), (5, " \n\t ", "b"), (6, "one", "c")]
    out += [(7, " ".join(words(40, 3, 5000) + shared), "a"), (8, " ".join(shared + words(30, 4, 5000)), None), (9, "x y " * 100, "a")]
    out += [(10, " ".join(words(35, 5, 9)), "b"), (10, " ".join(words(35, 5, 9)), "b"), (None, "null id\nwith\x0bwords\xa0here", "c")]
    out += [(11, " ".join(words(20_000, 6, 10_000)), "a"), (12, " ".join(base[:60] + ["changed"] + base[61:]), "a"), (13, "ß Straße \U0001f600  two  spaces ", "b")]
    return out


def same(got, want):
    key = repr
    assert sorted(got, key=key) == sorted(want, key=key)


# 1


def brute_substring(rows, window):
    docs = [(t or "").encode().split() for _, t, _ in rows]
    starts = collections.Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for (doc, *_), d in zip(rows, docs):
        gone = set()
        for i in range(len(d) - window + 1):
            if starts[tuple(d[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(d) if i not in gone)
        out.append((doc, len(d), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window,chunk,cells,fan", [(35, 8 << 20, 4_000_000, None), (35, 3_000, 500, None), (1, 3_000, 2_000, 3), (2, 10_000, 700, 1), (7, 1_000, 1_000, 4), (35, 3_000, 500, 5)])
def test_substring_dedup(spark, rows, window, chunk, cells, fan):
    got = substring_dedup.substring_dedup(documents(spark, rows), window, chunk, cells, fan=fan).collect()
    same([tuple(r) for r in got], brute_substring(rows, window))


def test_substring_dedup_on_odd_tables(spark):
    assert substring_dedup.substring_dedup(documents(spark, [])).count() == 0
    long = "x" * 300_000
    odd = [(1, f"{long} a {long}b", "a"), (2, " " * 200_000 + "a", "b"), (3, None, None), (3, None, None), (4, f"\n{long}\ta  {long}b ", "a"), (5, f"{long} a {long}c", "a")]
    got = substring_dedup.substring_dedup(documents(spark, odd), 3, carry=["source", "n_chars"])
    same([tuple(r[:4]) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], brute_substring(odd, 3))
    text = {r["doc_id"]: r["kept_text"] for r in got.collect()}
    assert text[1] == text[4] == "" and text[2] == odd[1][1] and text[3] is None and text[5] == odd[5][1]
    assert {(r["doc_id"], r["source"]) for r in got.collect()} == {(i, s) for i, _, s in odd}


def test_words_in_bytes():
    texts = ["", " a\x0bbc ", None, "d", "\u00a0\u2003x", "  ", "é" * 300 + " y"]
    data, at = substring_dedup.text_bytes(pa.chunked_array([pa.array(["zz", *texts[:3]])[1:], pa.array(texts[3:])]))
    start, end = substring_dedup.word_bounds(data, at)
    assert [data[a:b].tobytes() for a, b in zip(start, end)] == [w for t in texts for w in (t or "").encode().split()]
    one, two = span_hashes(data, start, end, WORD_LETTERS)
    assert len(set(one.tolist())) == len(set(two.tolist())) == 6
    again = span_hashes(*(lambda d, a: (d, *substring_dedup.word_bounds(d, a)))(*substring_dedup.text_bytes(pa.chunked_array([["q bc", "é" * 300]]))), WORD_LETTERS)
    assert again[0][1] == one[1] and again[1][2] == two[4]


def test_window_keys_tell_windows_apart():
    h = np.random.default_rng(0).integers(0, 1 << 63, (2, 40_000)).astype(np.uint64)
    for window in (1, 2, 3, 5, 35, 64):
        k1, k2 = substring_dedup.window_keys(h, window)
        assert len(k1) == 40_000 - window + 1 == len(set(zip(k1.tolist(), k2.tolist())))
        again, _ = substring_dedup.window_keys(h[:, 33_000 : 33_000 + window], window)
        assert again[0] == k1[33_000]


def test_cells_are_packed_losslessly():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 1000).astype(np.uint64))
    assert (substring_dedup.unpacked_cells(substring_dedup.packed_cells(x)) == x).all()
    assert substring_dedup.twice(np.array([3, 1, 1, 1, 2, 2], np.uint64)).tolist() == [1, 1, 2, 2, 3]


# 2


def test_language_model_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def brute_language(text, model):
    """By whole-text compression of each block, without any of the operator's helpers."""
    import zstandard

    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = bytes(b if b not in b"\t\n\v\f\r" else 32 for b in text.lower().encode() if b >= 128 or 97 <= b <= 122 or b in b" \t\n\v\f\r")
    total = []
    for k, (lang, words, context) in enumerate(model.languages):
        d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size = lambda x, d=d: len(zstandard.ZstdCompressor(level=5, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(x))
        n = max(0, size(context + data) - size(context)) if len(data) < 500 else sum(size(data[i : i + 4096]) for i in range(0, len(data), 4096))
        total.append((n, k, lang))
    (a, _, best), (b, *_) = sorted(total)[:2]
    return best, 1 - a / b if b else 0.0


def test_language_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.held_out("doc_id")))
    got = language_id.identify_language(docs, model).collect()
    for r in got:
        want = brute_language(r["text"], model)
        assert (r["lang_pred"], round(r["score"], 9)) == (want[0], round(want[1], 9))
    # At a tie the language with more rows is preferred.
    tied = spark.createDataFrame([("b", "mmm nnn ooo")] * 2 + [("a", "mmm nnn ooo")], "lang string, text string").withColumn("doc_id", F.lit(1))
    model = language_id.fit(tied)
    assert [x for x, *_ in model.languages] == ["b", "a"]
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify_language(tied, model).collect()} == {("b", 0.0)}


def test_language_odd_cases(spark, rows):
    docs = documents(spark, rows)
    model = language_id.fit(docs)
    assert [x for x, *_ in model.languages] and language_id.fit(docs.limit(0)).languages == []
    out = language_id.identify_language(docs, model)
    assert set(docs.columns) < set(out.columns)
    for r in out.collect():
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert not (r["lang_pred"] == "und") or (r["score"] == 0 and r["rejected"])
    assert {r["lang_pred"] for r in language_id.identify_language(docs, language_id.Model([])).collect()} == {"und"}
    assert language_id.identify_language(docs.limit(0), model).count() == 0


# 3


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def test_sentencepiece_equals_the_library(library):
    r, coder = random.Random(7), sentencepiece_bpe.bpe(queries.PIECES)
    letters = "aab bc  th\n\té▁ñ字\x00ﬁe‍\U0001f600 setaoin"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(3000)]
    texts += ["", " ", "a" * 3000, "ab" * 999, " " * 50, "banana" * 50, "".join(r.choice("etaoinsh") for _ in range(5000))]
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == library.encode(text) + [2]
        assert coder.decode(ids) == library.decode(ids.tolist())
    for _ in range(2000):
        ids = [r.choice([r.randint(0, 300), r.randint(0, 31999), 28705, 264]) for _ in range(r.randint(0, 8))]
        assert coder.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_sentencepiece_very_long_words(library):
    r, coder = random.Random(8), sentencepiece_bpe.bpe(queries.PIECES)
    texts = ["".join(r.choice(letters) for _ in range(r.choice((201, 900, 4000)))) for letters in ("ab", "aab", "etaoinsh", "=-_", "0123456789abcdef", "é字a\U0001f600", "the") for _ in range(12)]
    texts += [x * n for x in ("a", "=", "ab", "aab", "-=", "the", "é", "字", "00", "banana", "\U0001f600") for n in (201, 1000, 1337)]
    texts += ["".join(r.choice(("aaa", "=====", "ab" * 9, "x", "then")) for _ in range(900)) + " " + "a" * 300]
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == library.encode(text) + [2]
        assert coder.decode(ids) == library.decode(ids.tolist())
    begin = time.time()
    for text in ("".join(r.choice("etaoinsh") for _ in range(1_000_000)), "ab" * 500_000, "a" * 1_000_000):
        ids, _ = coder.ids_of([text.encode()])
        assert coder.decode(ids) == text
    assert time.time() - begin < 60


def test_sentencepiece_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(sentencepiece_bpe, "GATHER", 64)
    coder, r = sentencepiece_bpe.Bpe(queries.PIECES), random.Random(9)
    coder.known.words = 50
    for _ in range(30):
        texts = [" ".join("".join(r.choice("abcdé▁") for _ in range(r.choice((1, 2, 3, 90)))) for _ in range(r.randint(0, 40))) for _ in range(5)]
        ids, end = coder.ids_of([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(ids, end[:-1])] == [library.encode(t) + [2] for t in texts]
        assert coder.decimals_of(ids, end) == [" ".join(map(str, library.encode(t) + [2])).encode() for t in texts]
        assert coder.texts_of(ids, end) == [library.decode(library.encode(t)).encode() for t in texts]
    assert len(coder.known.size) < 700 and coder.known.size.max() < 2000


def test_sentencepiece_digest(spark, rows, library):
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "") + [2]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    same([tuple(r) for r in sentencepiece_bpe.sentencepiece_digest(documents(spark, rows), queries.PIECES).collect()], want)
    both = sentencepiece_bpe.sentencepiece_encode(documents(spark, rows), queries.PIECES, decoded="decoded")
    assert all(r["decoded"] == (r["text"] or "") for r in both.collect())
    coded = both.drop("decoded")
    assert sentencepiece_bpe.sentencepiece_digest(documents(spark, []), queries.PIECES).count() == 0
    assert sentencepiece_bpe.sentencepiece_encode(documents(spark, []), queries.PIECES, decoded="decoded").count() == 0
    for r in sentencepiece_bpe.sentencepiece_decode(coded, queries.PIECES).collect():
        assert r["ids"] == library.encode(r["text"] or "") + [2] and r["decoded"] == (r["text"] or "")


# 4


def test_matroska_round_trip(spark, rows):
    for r in matroska.matroska_digest(documents(spark, rows)).join(documents(spark, rows).select("doc_id", "text"), "doc_id").collect():
        data = (r["text"] or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = matroska.written_media(payload)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(media), hashlib.sha256(media).hexdigest(), matroska.feature(payload, matroska.Media(media)))
    assert matroska.matroska_digest(documents(spark, rows)).count() == len(rows)
    assert matroska.matroska_digest(documents(spark, [])).count() == 0
    same_text = {r["media_sha256"] for r in matroska.matroska_digest(documents(spark, [(1, "x y", "a"), (1, "x y", "a"), (2, "x y", None)])).collect()}
    assert len(same_text) == 1


def test_matroska_lacing_unknown_sizes_and_damage(spark):
    frames = [bytes([k]) * n for k, n in enumerate((5, 300, 7, 255))]
    xiph = bytes([3, 5, 255, 45, 7]) + b"".join(frames)
    kind, laced = matroska.laced(frames)
    assert kind == matroska.EBML_LACING
    blocks = b""
    for k, (kind, data) in enumerate(((matroska.XIPH, xiph), (matroska.EBML_LACING, laced), (matroska.FIXED, b"\x01" + b"ab" * 4))):
        blocks += matroska.element(matroska.SIMPLE_BLOCK, b"\x82" + (k * 10 - 5).to_bytes(2, "big", signed=True) + bytes([kind << 1]) + data)
    group = matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, b"\x81\x00\x09\x00abc"))
    unknown = lambda id_, data: id_.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + data
    cluster = unknown(matroska.CLUSTER, matroska.number(matroska.TIMESTAMP, 100) + blocks + group)
    data = matroska.HEAD + unknown(matroska.SEGMENT, matroska.element(0xEC, bytes(9)) + matroska.TRACK_HEAD + cluster + cluster)
    media = matroska.Media(data)
    assert media.error is None and len(media.clusters) == 2
    assert [data[p[2] : p[2] + p[3]] for p in media.packets[:4]] == frames == [data[p[2] : p[2] + p[3]] for p in media.packets[4:8]]
    assert [p[1] // 1_000_000 for p in media.packets[:11]] == [95] * 4 + [105] * 4 + [115] * 2 + [109]
    df = spark.createDataFrame([(1, data), (2, data[:-9]), (3, b""), (4, None), (5, b"junk" * 9)], "doc_id long, media binary")
    errors = {r["doc_id"]: r["error"] for r in matroska.matroska_errors(df).collect()}
    assert errors[1] is None and all(errors[k] for k in (2, 3, 4, 5))
    packets = matroska.matroska_packets(df).filter("doc_id = 1").orderBy("packet").collect()
    assert len(packets) == 22 and packets[0]["track"] == 2
    group = matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, b"\x82\x00\x01\x00abc") + matroska.element(matroska.REFERENCE, b"\xff"))
    track = matroska.element(matroska.TRACKS, matroska.element(matroska.TRACK, matroska.number(matroska.NUMBER, 2) + matroska.number(matroska.FRAME_NS, 40_000_000)))
    clusters = [matroska.element(matroska.CLUSTER, matroska.number(matroska.TIMESTAMP, 1000 * k) + blocks + group) for k in range(4)]
    body, cues = track, b""
    for k, c in enumerate(clusters):
        cues += matroska.element(matroska.CUE, matroska.number(matroska.CUE_TIME, 1000 * k) + matroska.element(matroska.CUE_AT, matroska.number(matroska.CUE_TRACK, 2) + matroska.number(matroska.CUE_CLUSTER, len(body))))
        body += c
    data = matroska.HEAD + matroska.element(matroska.SEGMENT, body + matroska.element(matroska.CUES, cues))
    media = matroska.Media(data)
    assert [p[1] // 1_000_000 for p in media.packets[:4]] == [-5, 35, 75, 115] and [p[4] for p in media.packets[:11]] == [False] * 11
    assert not media.packets[10][4] and data[media.packets[10][2] :][:3] == b"abc"
    assert matroska.Media(data, 2_500_000_000).packets == [p for p in media.packets if p[1] >= 1_900_000_000]
    assert matroska.Media(data, 0).packets == media.packets
    for n in (0, 1, 126, 127, 128, 16382, 16383, 70_000):
        assert matroska.read_vint(matroska.vint(n) + bytes(9), 0)[0] == n


# 5

PAGE = """<html><head><title>T</title><script>if (a < b) x = "</p>";</script></head><body class="has-sidebar"><header>Site</header><nav><a href=/x>Menu</a></nav>
<div class=tagline>Our slogan</div><div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p><b>First   para<br>graph<p>Second&#233;
para</p><div class="ad">Buy</div><form>Name <input></form><ul><li>one<li>two</ul><div class=share-box2>Share this</div></article><div id="comments">Me too</div><footer>&copy; 1</footer></body></html>"""


def test_main_text(spark):
    host = [(k, f"http://Host.example/{k}", f"<body><div class=tagline>Our slogan</div><div><p>Own {k}</p></div><p>Same text everywhere</p>") for k in range(40)]
    rows = [(100, "http://a.example/", PAGE), (101, None, None), (102, "http://a.example/e", ""), (103, "junk", "plain  text &lt;b&gt;"), (103, "junk", "plain  text &lt;b&gt;"), (104, "x", "<p>open <i>tag"), *host]
    got = collections.defaultdict(list)
    for r in html_template.extract_main_text(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, hash string")).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[100] == ["Head & line\nFirst para graph\nSecondé para\none\ntwo"]
    assert got[101] == got[102] == [""] and got[103] == ["plain text <b>"] * 2 and got[104] == ["open tag"]
    assert all(got[k] == [f"Own {k}"] for k in range(40))


def test_shared_prose_inside_articles_stays(spark):
    rows = [(k, "http://h.example/a", f"<article><p>Licence text</p><p>{k}</p><div>Widget</div></article>") for k in range(30)]
    got = html_template.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {f"Licence text\n{k}" for k in range(30)}


# 6


def test_url_rules_and_graph(spark):
    link = '<a class="x" HREF="http://Bad.example.com/en/1">b</a><a href="//bad.example.com/">c</a><a href="/own">'
    rows = [
        (1, "http://bad.example.com/en/1", ""), (2, "https://WWW.Example.COM/en/7?q", None), (3, "http://example.net/de/8", ""), (4, "http://x.net/de/9#f", ""), (5, "http://linker.info/", link),
        (6, "http://good.info/", '<a href="http://friend.info">'), (7, None, link), (8, "no scheme/en/", link), (9, "http://friend.info/x", ""), (10, "http://notcom/en/", ""), (11, "a://b.org/es/://c", ""), (11, "a://b.org/es/://c", ""), (12, "http://good.net/de/1", '<a href=http://friend.info/>'),
    ]
    got = {r["page_id"]: r for r in url_graph.judge_urls(spark.createDataFrame([(*r, "s", 1) for r in rows], "page_id long, url string, html string, host string, rank int"), queries.RULES).collect()}
    assert [(got[k]["rule"], got[k]["verdict"]) for k in (1, 2, 3, 4, 11)] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block")]
    assert (got[2]["host"], got[2]["path"]) == ("www.example.com", "/en/7") and got[11]["host"] == "b.org"
    assert got[5]["rule"] is None and got[5]["verdict"] == "block" and got[5]["distrust"] > 0
    assert got[9]["verdict"] == "allow" and got[9]["trust"] > 0
    assert got[7]["host"] == got[8]["host"] == got[7]["path"] == "" and got[7]["verdict"] == "allow"
    assert url_graph.judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), queries.RULES).count() == 0


def test_url_rules_of_equal_length(spark):
    rows = spark.createDataFrame([(1, "http://x.com/ab/1", None), (1, "http://x.com/ab/1", None), (2, "http://y.com/ab", "")], "page_id long, url string, html string")
    got = url_graph.judge_urls(rows, [("block", "x.com/"), ("allow", "com/ab")]).collect()
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in got) == [(1, "com/ab", "allow")] * 2 + [(2, "com/ab", "allow")]


def test_page_rank_against_brute_force(spark):
    r = random.Random(3)
    edges = {(r.randrange(12), r.randrange(12)): r.randint(1, 4) for _ in range(40)}
    seeds = {1: 2, 5: 1}
    df = spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in edges.items()], "src string, dst string, w long")
    got = {x["host"]: x["rank"] for x in url_graph.propagate(df, spark.createDataFrame([(f"h{k}", n) for k, n in seeds.items()], "host string, n long"), 7).collect()}
    out, seed = collections.Counter(), {k: 10**15 // 3 * n for k, n in seeds.items()}
    for (a, _), w in edges.items():
        out[a] += w
    rank = dict(seed)
    for _ in range(7):
        new = collections.Counter({k: s * 15 // 100 for k, s in seed.items()})
        for (a, b), w in edges.items():
            new[b] += rank.get(a, 0) * 85 // 100 // out[a] * w
        rank = dict(new)
    assert got == {f"h{k}": v for k, v in rank.items() if f"h{k}" in got} and set(got) >= {f"h{k}" for k, v in rank.items() if v}


# 7


@pytest.mark.parametrize("shard", [16_384, 30])
def test_top_k(spark, shard):
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 8)) * 2
    x[100:200] = x[100]
    data = [(k, v.tolist(), 1, 2) for k, v in enumerate(x)] + [(900, None, 1, 2), (1000, [1.0, None] + [0.0] * 6, 1, 2), (1100, [math.nan] * 8, 1, 2), (1200, [math.inf] * 8, 1, 2), (1300, [1.0, 2.0], 1, 2), (1301, [1.0, 3.0], 1, 2), (1400, [], 1, 2)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, shard int, dim int")
    v = balltree.integer_vectors(df)
    got = collections.defaultdict(list)
    for row in balltree.top_k(v, v.filter("vec_id % 100 = 0"), 10, shard).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append((row["rank"], row["vec_id"], row["score"]))
    y = np.floor(x * 1024).astype(np.int64)
    for q in range(0, 600, 100):
        s = y @ y[q]
        want = sorted((-int(s[j]), j) for j in range(600) if j != q)[:10]
        assert got[q] == [(k + 1, j, -n) for k, (n, j) in enumerate(want)]
    assert got[1300] == [(1, 1301, 1024 * 1024 * 7)] and set(got) == {0, 100, 200, 300, 400, 500, 1300}
    assert balltree.top_k(v.limit(0), v.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [16_384, 40])
def test_top_k_of_repeated_ids_and_rows(spark, shard):
    """Every row is a query of its own and a candidate of all others, whatever ids they share."""
    r = np.random.default_rng(6)
    x = r.integers(-3, 4, (300, 5))
    ids = [int(i) for i in r.integers(0, 12, 300) * 50]
    x[40:60], ids[40:50] = x[40], [100] * 10
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, v array<long>")
    got = collections.Counter(map(tuple, balltree.top_k(df, df.filter("vec_id % 100 = 0"), 7, shard).collect()))
    want = collections.Counter()
    for q in range(300):
        if ids[q] % 100 == 0:
            s = x @ x[q]
            best = sorted((-int(s[j]), ids[j]) for j in range(300) if j != q)[:7]
            want.update((ids[q], k + 1, j, -n) for k, (n, j) in enumerate(best))
    assert got == want


def test_top_k_prunes_far_centres(spark, monkeypatch):
    monkeypatch.setattr(balltree, "CENTRES", 8)
    r = np.random.default_rng(8)
    x = (r.normal(size=(2000, 6)) + r.normal(size=(5, 6))[r.integers(0, 5, 2000)] * 30).round().astype(np.int64)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, v array<long>")
    got = balltree.top_k(df, df.filter("vec_id % 100 = 0"), 10, 50).orderBy("query_id", "rank").collect()
    for q in range(0, 2000, 100):
        s = x @ x[q]
        want = sorted((-int(s[j]), j) for j in range(2000) if j != q)[:10]
        assert [(g["vec_id"], g["score"]) for g in got if g["query_id"] == q] == [(j, -n) for n, j in want]


# 8


def test_huffman_files(spark, rows):
    tokenizer = Tokenizer.from_file(queries.BYTES)
    ids = sorted(((-1 if i is None else i), tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows)
    want, start = [], 0
    for i, x in ids:
        want.append((None if i < 0 else i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    got = huffman.huffman_token_files(documents(spark, rows), queries.BYTES, queries.BYTES_IDS).collect()
    same([tuple(r) for r in got], want)
    tokens = huffman.tokenized(documents(spark, rows), queries.BYTES)  # not written: computed twice
    blocks, lengths = huffman.huffman_write(tokens, queries.BYTES_IDS, shards=4)
    back = huffman.huffman_read(blocks, lengths, keep_ids=True).collect()
    same([tuple(r["ids"]) for r in back], [tuple(x) for _, x in ids])
    assert huffman.huffman_token_files(documents(spark, rows).limit(0), queries.BYTES, queries.BYTES_IDS).count() == 0


def test_huffman_shards_of_one_doc_id(spark, monkeypatch):
    """A third of all rows without a doc_id, and a third with the same, fill shards of their own."""
    monkeypatch.setattr(huffman, "SHARD", 300)
    r = random.Random(10)
    rows = [(i, " ".join(r.choice("abcdefg") * 3 for _ in range(r.randint(0, 9))), "a") for i in [None] * 150 + [7] * 150 + list(range(150))]
    got = huffman.huffman_token_files(documents(spark, rows), queries.BYTES, queries.BYTES_IDS).collect()
    tokenizer = Tokenizer.from_file(queries.BYTES)
    want = collections.Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t, _ in rows for x in [tokenizer.encode(t, add_special_tokens=False).ids + [2]])
    assert collections.Counter((g["doc_id"], g["n_tokens"], g["ids_crc32"]) for g in got) == want
    at = 0
    for g in sorted(got, key=lambda g: g["start"]):
        assert g["start"] == at
        at += g["n_tokens"]
    ids = [-1 if g["doc_id"] is None else g["doc_id"] for g in sorted(got, key=lambda g: g["start"])]
    assert ids == sorted(ids)
    bounds, parts = huffman.stretches(huffman.tokenized(documents(spark, rows), queries.BYTES), 3000)
    assert (parts > 1).sum() == 2 and bounds[0] == huffman.NULL


def test_tokenizer_stretches():
    r, coder = random.Random(9), huffman.Ids(queries.BYTES)
    letters = "aab bc  th\n\n\té1'sñ字\x00ﬁ\xa0\u3000\x85\x1c\U0001f600 s.,"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["a <|endoftext|> b", "<|endoftext|>", "it's don't. 'tis we'll' x's, 12, a1. (b) c), ü. ñ's -- e.g.\nNew line."]
    for end in (None, 2):
        coder.known.words = 300
        for k in range(0, len(texts), 700):
            ids, stop = coder.encode(texts[k : k + 700], end)
            for t, x in zip(texts[k : k + 700], np.split(ids, stop[:-1])):
                assert x.tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids + [end] * (end is not None)


@pytest.mark.parametrize("counts,limit", [([1], 18), ([0, 3, 0, 1], 18), ([2**k for k in range(30)], 10), ([1] * 1024, 10), ([5, 1, 1, 1, 9], 3)])
def test_code_lengths(counts, limit):
    lengths = huffman.code_lengths(np.array(counts), limit)
    used = lengths[lengths > 0]
    assert (lengths > 0).tolist() == [c > 0 for c in counts] and used.max() <= limit
    assert sum(2.0**-n for n in used.tolist()) <= 1
    if len(counts) <= 5:  # no code of the same limit is shorter
        k = [c for c in counts if c]
        best = min((sum(a * b for a, b in zip(k, x)) for x in itertools.product(range(1, limit + 1 if limit < 6 else 6), repeat=len(k)) if sum(2.0**-n for n in x) <= 1), default=0)
        assert sum(a * b for a, b in zip(counts, lengths.tolist())) == best


# 9


def brute_simhash(rows, shingle=3, most=2):
    prints = []
    for i, t, _ in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        g = [b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= most and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if x == old else x for x in group]
    first = {g: min((i for (i, _), x in zip(prints, group) if x == g and i is not None), default=None) for g in group}
    return [(i, f"{p:016x}", first[g]) for (i, p), g in zip(prints, group)]


def test_simhash(spark, rows):
    base = words(200, 11, 5000)
    more = [(100 + k, " ".join(base[:k] + ["X"] + base[k + 1 :]), "a") for k in range(0, 200, 9)]
    got = simhash.simhash_near_duplicates(documents(spark, rows + more)).collect()
    same([tuple(r) for r in got], brute_simhash(rows + more))
    assert simhash.simhash_near_duplicates(documents(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("home", [simhash.HOME, 3])
def test_no_link_is_lost(spark, home):
    r = random.Random(12)
    centres = [r.getrandbits(64) for _ in range(20)]
    prints = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for c in centres for _ in range(30)}
    df = spark.createDataFrame([(p.to_bytes(8, "big"),) for p in prints], "fingerprint binary")
    found = connected_components(simhash.links(df, home=home)).collect()
    component = {int.from_bytes(x["node"], "big"): int.from_bytes(x["component"], "big") for x in found}
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            assert component[a] == component[b]
    for x in found:
        assert x["component"] <= x["node"]


def test_every_string_is_near_one_anchor():
    x = np.random.default_rng(2).integers(0, 1 << 63, (2000, 1)).astype(np.uint64)
    who, anchor, spent = simhash.anchors(x, [(0, 0, 23)], 2)
    assert (np.bincount(who[spent == 0]) == 1).all()
    apart = np.bitwise_count((x[who, 0] & np.uint64((1 << 23) - 1)) ^ anchor)
    assert (np.maximum(apart.astype(int) - 3, 0) == spent).all() and len(who) / 2000 == pytest.approx(21.75, abs=0.3)


def test_near_duplicates_by_two_lanes(spark):
    base = words(300, 13, 5000)
    texts = [" ".join(base), " ".join(base[:50] + ["other"] + base[51:]), " ".join(words(300, 14, 5000)), " ".join(words(300, 15, 5000))]
    got = simhash.simhash_near_duplicates(documents(spark, [(k, t, "a") for k, t in enumerate(texts)]), shingle=5, lanes=2, most=26, projections=simhash.thirds(2), lane_most=13).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 103: 100}


# 10


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 50.0, "b": 100.0, "c": 150.0}
    got = mixing.targets({"a": 1000, "b": 1000, "c": 10, None: 90})
    assert got["c"] == 30.0 and sum(got.values()) == pytest.approx(2100) and got["b"] / got["a"] == pytest.approx(2) and got[None] == pytest.approx(270)
    assert mixing.targets({"a": 0, "b": 5}) == {"a": 0.0, "b": 5.0} and mixing.targets({}) == {}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    got = mixing.permuted(np.arange(n), n, 12345)
    assert sorted(got.tolist()) == list(range(n))


def test_mixing(spark, rows):
    docs = documents(spark, [*rows, *[(1000 + k, " ".join(words(50 + k, k)), ("a", "b", "ü", None)[k % 4]) for k in range(200)]])
    got = mixing.mix_digest(docs, block=16).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_digest(docs.repartition(5), block=16).collect()))
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        size[r["source_size"]] += r["size"]
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert len(got) == len(rows) + 200 and all(k == v for k, v in size.items())
    assert all(abs(taken[k] - target[k]) <= max(3 * 16, 0.002 * target[k]) for k in size if target[k] < 2.99 * k)
    assert mixing.mix_digest(docs.limit(0)).count() == 0
    texts = mixing.mix_texts(docs.filter("doc_id >= 1000"), block=16)
    assert texts.columns == docs.columns
    by = collections.Counter()
    for r in texts.collect():
        by[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    want = {r["doc_id"]: r["taken"] for r in mixing.mix_digest(docs.filter("doc_id >= 1000"), block=16).collect()}
    assert {k: v for k, v in want.items() if v} == dict(by)


def test_draws_are_exact():
    got = mixing.draws({"a": 1000, "b": 17, None: 4}, 3, 100)
    assert np.sum(got, axis=0).tolist() == [1000, 17, 4] and all(sum(x) == 100 for x in got[:-1])


def test_scratch_is_cleared(spark):
    import os

    from casefile.llm.common import written
    from casefile.session import clear_scratch, scratch

    assert written(spark.range(3), "x").count() == 3 and os.path.isdir(scratch(spark))
    clear_scratch(spark)
    assert not os.path.exists(scratch(spark))
