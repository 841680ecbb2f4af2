"""Class rules never take a page's article; recurrence does not depend on the host's size."""

import collections
import random
import time

import pytest

from casefile.llm import html_template


def texts(spark, rows):
    got = html_template.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r["page_id"]: r["text"] for r in got}


NAMES = ["content has-sidebar", "no-sidebar", "nav-open", "article-share", "no-comments", "sidebar", "widget"]


def kept(source):
    page = html_template.Page(source)
    keep = page.chosen()
    return " ".join(x for _, n, t in page.segments if keep[n] and (x := t.strip()))


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("tag", ["article", "main"])
def test_wrappers_keep_the_article(name, tag):
    assert kept(f"<body><nav>Menu</nav><div class='{name}'><{tag}><p>Text</p><div class='ad'>Buy</div></{tag}></div></body>") == "Text"


def test_whole_names_are_boilerplate():
    for name in ("sidebar", "x share", "share-box2", "cookie-notice", "Widget_3"):
        assert kept(f"<body><article>Text</article><div class='{name}'><article>Teaser</article></div></body>") == "Text"
        assert kept(f"<body><p>Text</p><div id='{name.split()[-1]}'>Other</div></body>") == "Text"


def test_templates_of_small_and_large_hosts(spark):
    page = lambda k, block: f"<body>{block}<div><p>Own {k}</p></div></body>"
    slogan = "<div class=tagline>Our slogan</div>"
    small = [(k, f"http://small.example/{k}", page(k, slogan)) for k in range(4)]
    large = [(100 + k, f"http://large.example/{k}", page(k, slogan if k < 12 else "")) for k in range(400)]
    copies = [(900 + k, f"http://copies.example/{k}", page(0, "<div>Same page</div>")) for k in range(5)]
    got = texts(spark, [*small, *large, *copies])
    assert all(got[k] == f"Own {k}" for k in range(4)) and all(got[100 + k] == f"Own {k}" for k in range(400))
    assert all(got[900 + k] == "Same page\nOwn 0" for k in range(5))


STORY = "<article><h1>Story</h1><div class='social-history'><p>The whole story of the page.</p></div><p>End.</p></article>"


def test_copies_and_mirrors_lose_nothing(spark):
    rows = [(1, "http://a.example/1", STORY)] * 12
    rows += [(100 + k, f"http://b.example/1?utm={k}", f"<head><link href=/1?utm={k}></head><nav>{k}</nav>{STORY}") for k in range(12)]
    rows += [(200 + k, f"http://c.example/{k}", f"<p>Seen on {k}</p>{STORY.replace('End', 'End ' + str(k))}") for k in range(12)]
    got = texts(spark, rows)
    assert got[1] == got[105] == "Story\nThe whole story of the page.\nEnd."
    assert got[205] == "Story\nThe whole story of the page.\nEnd 5."


def test_recurring_teasers_go(spark):
    teaser = "<article class=teaser><h2>Read this, too</h2></article>"
    got = texts(spark, [(k, f"http://t.example/{k}", f"<article><h1>Title {k}</h1><p>{'word ' * 9}{k}</p></article>{teaser}") for k in range(15)])
    assert all(v == f"Title {k}\n{'word ' * 9}{k}" for k, v in got.items())


def counted(rows, least=html_template.PAGES, few=html_template.FEW):
    """By brute force: each host's recurring subtrees, and each page's text without them."""
    pages, seen, hosts = {}, collections.defaultdict(set), collections.defaultdict(set)
    for i, url, source in rows:
        page = html_template.Page(source)
        kept = page.chosen()
        segments = [x for x in page.segments if kept[x[1]]]
        text, host = html_template.joined_blocks(segments), url.split("/")[2].lower()
        pages[i] = page, segments, host
        hosts[host].add(text)
        for h in {h for h in page.candidates(kept) if h is not None}:
            seen[host, h].add(text)
    out, changed = {}, 0
    for i, (page, segments, host) in pages.items():
        enough = min(least, max(few, -(-len(hosts[host]) // 2)))
        hashes, left = page.candidates(page.chosen()), []
        for x in segments:
            n, gone = x[1], False
            while n >= 0:
                under = lambda m, n=n: m == n or (m > 0 and under(page.parent[m]))
                size = sum(sum(map(len, t.split())) for _, m, t in segments if under(m))
                gone |= hashes[n] is not None and len(seen[host, hashes[n]]) >= enough
                assert hashes[n] is None or not page.article[n] or 2 * size <= sum(sum(map(len, t.split())) for *_, t in segments)
                n = page.parent[n]
            if not gone:
                left.append(x)
        out[i] = html_template.joined_blocks(left)
        changed += out[i] != html_template.joined_blocks(segments)
    return out, changed


def test_templates_against_brute_force(spark):
    r = random.Random(4)
    blocks = [f"<div><p>Block {k}</p><ul><li>one<li>two {k}</ul></div>" for k in range(4)] + ["<section><h2>Same</h2></section>", "<table><tr><td>x<td>y</table>", "<p>Shared words</p>"]

    def page(k):
        inner = "".join(r.sample(blocks, 3))
        own = "".join(f"<p>{' '.join(r.choice('abcdef') * 5 for _ in range(9))} {k}</p>" for _ in range(3))
        wrap = r.choice(("<article>{}</article>", "<div class=page>{}</div>", "<main><section>{}</section></main>", "{}"))
        return f"<body><nav><ul><li>Home</ul></nav>{r.choice(blocks)}{wrap.format(own + inner)}<footer>(c)</footer></body>"

    rows = [(k, f"http://Host{k % 3}.example/{k}", page(k)) for k in range(75)] + [(100 + k, "http://tiny.example/", page(k)) for k in range(3)]
    rows += [(200 + k, f"http://host1.example/{k}", rows[1][2]) for k in range(5)]
    want, changed = counted(rows)
    assert texts(spark, rows) == want and changed > 40


def test_odd_pages_in_linear_time(spark):
    rows = [(1, "http://o.example/1", "<div>" * 40_000 + "deep" + "</div>" * 40_000), (2, "http://o.example/2", "<p>text <a href=\"open> " * 20_000), (3, "http://o.example/3", "<" * 300_000), (4, "http://o.example/4", "<ul><li>" + "<span>" * 20_000 + "<li>x" * 20_000), (5, "http://o.example/5", "<a b='" * 60_001), (6, None, None), (6, None, None), (7, "http://o.example/7", "<p>" + "word " * 400_000)]
    begin = time.time()
    got = texts(spark, rows)
    assert time.time() - begin < 60
    assert got[1] == "deep" and got[3] == "<" * 300_000 and got[4].startswith("x") and got[6] == "" and got[7] == ("word " * 400_000).strip()
    assert texts(spark, []) == {}


def test_quotes_in_tags():
    assert kept("<p title='a > b' class=\"x>y\">one</p><p>two <b a=\"open>three</b>") == "one two three"
    assert kept("1 < 2 and <3 <b>x</b> <!-- <p>no</p> --> y <!doctype z> </ p>") == "1 < 2 and <3 x y"
