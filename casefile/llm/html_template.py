"""Main text of web pages: site templates removed by subtree hashes counted over each host.

1. Every page is parsed once to elements and text segments, and stored so. Elements that are
   boilerplate by name, role or class are marked. Containers, inside the article and outside, and
   all other elements but prose inside an article give a hash of their whole subtree.
2. Hashes are counted by host in Spark: by how many pages with different main texts, so that copies
   and mirrors of a page count once. Recurring ones are joined back to pages.
3. A recurring subtree is deleted; what holds over half of a page's article is none. The text segments
   that stand in no deleted or marked subtree make the blocks of the result.
"""

from __future__ import annotations

import html
import json
import re

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.llm.common import pieces, written
from casefile.llm.url_graph import host_of

#: A subtree is a template if it stands on so many pages of its host, whatever the host's size. On a
#: host of under twice as many pages half of them are enough, but never under FEW.
PAGES, FEW = 10, 3
BEGIN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NUMBER = re.compile(r"[-_]?[0-9]+$")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BOILER = frozenset("head nav footer aside form button select script style textarea title noscript iframe template svg canvas object dialog menu math xmp noembed noframes datalist".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split())
MAIN = frozenset(("article", "main"))
WHOLE = frozenset(("main", "html", "head", "body"))
#: In an article only these are looked up among the templates; the rest is prose.
CONTAINERS = frozenset("div section ul ol dl table figure details header".split())
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLASSES = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner sidebar comment comments commentlist disqus respond nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices newsletter subscribe subscription share sharing social related recommended popup modal overlay pagination pager toolbar skip widget widgets".split())
#: Exact compounds that are boilerplate, too.
COMPOUNDS = frozenset("ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper author-box comment-form comment-list comments-area cookie-banner cookie-bar cookie-consent cookie-notice footer-nav main-menu main-nav nav-bar nav-links nav-menu newsletter-signup page-footer post-navigation related-articles related-links related-posts share-bar share-box share-buttons share-links side-bar sidebar-left sidebar-right site-footer site-nav skip-link social-links social-media social-share sponsored-content subscribe-box top-nav widget-area".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def attributes(text: str) -> dict[str, str]:
    return {name.lower(): html.unescape(value.strip("\"'")) for name, value in ATTRIBUTE.findall(text)} if text.strip(" /\t\n") else {}


def is_boilerplate(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """By tag, role or because it is hidden."""
    if tag in BOILER or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style", "").lower()):
        return True
    return attrs.get("role", "").lower() in ROLES


def has_boilerplate_name(tag: str, attrs: dict[str, str]) -> bool:
    """By a whole class name or the id; a number at its end does not count."""
    if not attrs or tag in ("html", "body"):
        return False
    names = {NUMBER.sub("", x).replace("_", "-") for x in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()}
    return not names.isdisjoint(CLASSES) or not names.isdisjoint(COMPOUNDS)


class Page:
    """Elements (parent, tag, boilerplate, in an article, hash) and segments (block, element, text).
    Parsing takes time in proportion to the page's length, however elements nest or quotes are left open."""

    def __init__(self, source: str):
        self.parent, self.tag, self.article, self.sums = [-1], [""], [False], [xxhash.xxh64()]
        self.ruled, self.named = [False], [False]
        self.segments: list[tuple[int, int, str]] = []
        #: Of each tag: where its open elements stand in the stack.
        self.open_at: dict[str, list[int]] = {}
        self.block, stack, at, look, end = 0, [0], 0, 0, len(source)
        self.quotes = True
        while m := BEGIN.search(source, look):
            if m[1]:
                stop = source.find("-->", m.end())
                stop = stop + 3 if stop >= 0 else end
            else:
                stop = self.tag_end(source, m.end()) if m[3] else source.find(">", m.end()) + 1
            if not stop:  # no tag: its sign is text
                look = m.start() + 1
                if source.find(">", look) < 0:
                    break
                continue
            self.text(source[at : m.start()], stack[-1])
            at = look = stop
            if not m[3]:
                continue
            tag = m[3].lower()
            if m[2]:
                self.close(tag, stack)
                continue
            self.open(tag, source[m.end() : stop - 1], stack)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                self.sums[stack[-1]].update(source[at : close.start() if close else end].encode("utf-8", "surrogatepass"))
                at = look = close.end() if close else end
                self.pop(stack)
        self.text(source[at:], stack[-1])
        while len(stack) > 1:
            self.pop(stack)
        self.boiler = self.marked()

    def tag_end(self, source: str, at: int) -> int:
        """Where a tag ends, past quoted values; 0 if it does not. Once a tag or a quote is left open
        to the page's end, quotes no longer count."""
        if self.quotes:
            look = at
            while m := STOP.search(source, look):
                if m[0] == ">":
                    return m.end()
                if (look := source.find(m[0], m.end()) + 1) == 0:
                    break
            self.quotes = False
        return source.find(">", at) + 1

    def text(self, data: str, node: int) -> None:
        if data:
            self.segments.append((self.block, node, html.unescape(data) if "&" in data else data))
            self.sums[node].update(" ".join(data.split()).encode("utf-8", "surrogatepass"))

    def open(self, tag: str, attrs: str, stack: list[int]) -> None:
        if tag in CLOSES_P:
            self.close("p", stack)
        if tag in ENDS:
            same, until = ({t: at[-1] for t in tags if (at := self.open_at.get(t))} for tags in ENDS[tag])
            if same and max(same.values()) > max(until.values(), default=-1):
                self.close(max(same, key=same.get), stack)
        if tag in BLOCK or tag == "br":
            self.block += tag != "br"
            if tag == "br":
                self.segments.append((self.block, stack[-1], " "))
        up = stack[-1]
        got = attributes(attrs) if attrs else {}
        self.parent.append(up)
        self.tag.append(tag)
        inside = self.article[up] or tag in MAIN
        self.ruled.append(is_boilerplate(tag, got, self.article[up]))
        self.named.append(has_boilerplate_name(tag, got))
        self.article.append(inside)
        self.sums.append(xxhash.xxh64(f"<{tag} {sorted(got.items())}>".encode("utf-8", "surrogatepass")))
        self.open_at.setdefault(tag, []).append(len(stack))
        stack.append(len(self.parent) - 1)
        if tag in VOID:
            self.pop(stack)

    def close(self, tag: str, stack: list[int]) -> None:
        if not self.open_at.get(tag):
            return
        while self.tag[self.pop(stack)] != tag:
            pass

    def pop(self, stack: list[int]) -> int:
        node = stack.pop()
        self.open_at[self.tag[node]].pop()
        self.block += self.tag[node] in BLOCK
        self.sums[stack[-1]].update(self.sums[node].digest())
        return node

    def marked(self) -> list[bool]:
        """Boilerplate elements, with all that they hold. A name does not count on an element that
        holds main, nor on one that holds an article where no other article or main is left."""
        named = self.named
        for tag in ("main", "article"):
            out: list[bool] = []
            holds = [t == tag for t in self.tag]
            for i in range(len(self.parent) - 1, 0, -1):
                holds[self.parent[i]] |= holds[i]
            if tag == "main" or not any(t in MAIN and not b for t, b in zip(self.tag, boiler)):
                named = [n and not h for n, h in zip(named, holds)]
            for p, r, n in zip(self.parent, self.ruled, named):
                out.append(r or n or (p >= 0 and out[p]))
            boiler = out
        return boiler

    def chosen(self) -> list[bool]:
        """Elements whose text may be main text: inside an article if there is one, else in main,
        else anywhere."""
        for names in (("article",), ("main",)):
            roots = {i for i, t in enumerate(self.tag) if t in names and not self.boiler[i]}
            if roots:
                out = []
                for i, p in enumerate(self.parent):
                    out.append((i in roots or (p >= 0 and out[p])) and not self.boiler[i])
                return out
        return [not b for b in self.boiler]

    def pruned(self, segments: list, hashes: list[int | None]) -> tuple[list[int], list[int | None], list]:
        """Parents, hashes and segments, with only the elements that have a hash and hold text."""
        up: list[int] = []  # of each element: itself or the nearest one around it that has a hash
        for i, p in enumerate(self.parent):
            up.append(i if hashes[i] is not None or not i else up[p])
        held = {0}
        for _, n, _ in segments:
            n = up[n]
            while n not in held:
                held.add(n)
                n = up[self.parent[n]]
        order = sorted(held)
        number = {n: k for k, n in enumerate(order)}
        return [number[up[self.parent[n]]] if n else -1 for n in order], [hashes[n] for n in order], [(b, number[up[n]], t) for b, n, t in segments]

    def candidates(self, kept: list[bool]) -> list[int | None]:
        """Hashes of the elements that may be templates: no prose inside an article, nor what an
        element marked by its tag or role holds, nor what has over half of an article's kept text."""
        chars = self.chars([s for s in self.segments if kept[s[1]]])
        out: list[int | None] = []
        inside: list[bool] = []
        for i, (p, tag) in enumerate(zip(self.parent, self.tag)):
            may = i and tag not in WHOLE and tag not in RAW and (tag in CONTAINERS or tag == "article" or not self.article[i]) and not (p >= 0 and inside[p])
            may = may and not (self.article[i] and 2 * chars[i] > chars[0])
            inside.append(self.ruled[i] or (p >= 0 and inside[p]))
            out.append(int.from_bytes(self.sums[i].digest(), "big", signed=True) if may else None)
        return out

    def chars(self, segments: list) -> list[int]:
        """Characters of each element's text, without white space."""
        out = [0] * len(self.parent)
        for _, n, t in segments:
            out[n] += sum(map(len, t.split()))
        for n in range(len(out) - 1, 0, -1):
            out[self.parent[n]] += out[n]
        return out


PARSED = "page_id long, url string, html64 long, text64 long, hash array<long>, held int, body binary"
SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html64", pa.int64()), ("text64", pa.int64()), ("hash", pa.list_(pa.int64())), ("held", pa.int32()), ("body", pa.binary())])
RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def joined_blocks(segments: list) -> str:
    blocks: dict[int, list[str]] = {}
    for b, _, t in segments:
        blocks.setdefault(b, []).append(t)
    return "\n".join(x for b in blocks.values() if (x := " ".join("".join(b).split())))


def hash64(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Each page's hashes of possible templates (the first ``held`` of them stand in the body), and its
    body: elements and the segments of text that boilerplate does not hold, compressed, since they are
    stored and shuffled once each."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            for part in pieces(batch, "html"):
                out: dict[str, list] = {f.name: [] for f in SCHEMA}
                for i, url, source in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    page = Page(source or "")
                    kept = page.chosen()
                    hashes = page.candidates(kept)
                    segments = [s for s in page.segments if kept[s[1]]]
                    body = page.pruned(segments, hashes)
                    data = json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")
                    held = {h for h in body[1] if h is not None}
                    listed = [*sorted(held), *sorted({h for h in hashes if h is not None} - held)]
                    for name, value in zip(out, (i, url, hash64(source or ""), hash64(joined_blocks(segments)), listed, len(held), pack.compress(data))):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in SCHEMA], schema=SCHEMA)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, PARSED)


def without(parent: list[int], hashes: list[int | None], segments: list, gone: set[int]) -> list:
    """The segments that stand in no subtree of ``gone``."""
    lost: list[bool] = []
    for p, h in zip(parent, hashes):
        lost.append(h in gone or (p >= 0 and lost[p]))
    return [s for s in segments if not lost[s[1]]]


def extract_main_text(pages: DataFrame, least_pages: int = PAGES, few: int = FEW) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    ``pages`` has page_id, url and html; other columns are ignored. Blocks are joined by one \\n;
    white space inside a block is one space. Null and empty html have an empty text. Pages without
    a host form a host of their own. Repeated rows each give a row; pages of a host with an equal text
    count as one. Pages are read whole, however long. An empty table gives an empty result.
    """
    parsed = written(parsed_pages(pages), "pages")
    return assembled(parsed, template_subtrees(parsed, least_pages, few))


def template_subtrees(parsed: DataFrame, least_pages: int = PAGES, few: int = FEW) -> DataFrame:
    """host and h: the subtrees that recur on ``least_pages`` pages of a host with different texts (on
    half of them, but ``few`` at least, where the host has under twice as many)."""
    of_text = parsed.select(_host(), "text64", F.explode("hash").alias("h")).distinct()
    counted = of_text.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(few, least_pages))
    of_host = parsed.select(_host(), "text64").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    enough = F.least(F.lit(least_pages), F.greatest(F.lit(few), F.ceil(F.col("pages") / 2)))
    return counted.join(of_host, "host").filter(F.col("n") >= enough).select("host", "h")


def _host():
    return F.xxhash64(host_of(F.col("url"))).alias("host")


def assembled(parsed: DataFrame, templates: DataFrame) -> DataFrame:
    """The pages' texts without the templates of their hosts."""
    subtrees = parsed.select(_host(), "html64", F.explode(F.slice("hash", F.lit(1), F.col("held"))).alias("h"))
    drop = subtrees.join(templates, ["host", "h"]).groupBy("host", "html64").agg(F.collect_set("h").alias("drop"))

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in RESULT}
            for i, url, body, gone in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "body", "drop"))):
                *tree, segments = json.loads(zstandard.decompress(body).decode("utf-8", "surrogatepass"))
                whole = joined_blocks(without(*tree, segments, set(gone)) if gone else segments)
                for name, value in zip(out, (i, url, whole, len(whole))):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in RESULT], schema=RESULT)

    joined = parsed.select("page_id", "url", "html64", "body", _host()).join(drop, ["host", "html64"], "left")
    return joined.select("page_id", "url", "body", "drop").mapInArrow(run, "page_id long, url string, text string, n_chars long")
