"""WARC archives and main-text extraction."""

import hashlib
import html
import re
import time

import pytest
from pyspark.sql import types as T
from rowkin.llm import extraction, warc

LONG = "<html><body><p>" + "same page " * 30 + "</p></body></html>"
PAGES = [
    (1, "http://a.example/1", LONG), (2, "http://a.example/2", LONG), (3, None, LONG), (4, "http://b.example/x\r\ny%", ""), (5, "", None), (6, "u", "short"),
    (7, "u", "short"), (8, "http://a.example/8", LONG + "é日本"), (9, "http://b.example/9", "x" * 300_000), (9, "http://b.example/9", "x" * 300_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    names = ["page_id", "url", "html", "host", "path", "salt", "digest", "first", "archive", "offset"]
    kinds = [T.LongType()] + [T.StringType()] * 9
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    return spark.createDataFrame([(*p, *"abcdefg") for p in PAGES], schema).repartition(3)


def test_archives_round_trip(pages):
    folder, index = warc.write(pages)
    got = warc.read(folder, index, payloads=True).collect()
    first = {}
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        first[payload] = min(page_id, first.get(payload, page_id))
    expected = []
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        revisit = len(payload) >= 100 and first[payload] != page_id
        expected.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first[payload] if revisit else None, b"" if revisit else payload))
    assert sorted((tuple(r)[:5] + (bytes(r[5]),) for r in got), key=repr) == sorted(expected, key=repr)
    some = warc.read(folder, index.filter("page_id in (2, 8)")).collect()
    assert {r["page_id"] for r in some} == {2, 8}
    places = [(r["archive"], r["offset"], r["length"]) for r in index.collect()]
    assert len(set(places)) == len(PAGES)


def test_no_pages(pages):
    none = pages.limit(0)
    assert warc.read(*warc.write(none)).count() == 0 and extraction.extract(none).count() == 0


def test_reads_are_coalesced():
    assert warc.coalesced([(0, 10), (10, 5), (20, 5), (10_000_000, 5)]) == [(0, 25, [0, 1, 2]), (10_000_000, 10_000_005, [3])]


def test_extraction_on_odd_rows(pages):
    got = extraction.extract(pages).collect()
    assert len(got) == len(PAGES) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[5] == "" and text[6] == "short" and text[1] == ("same page " * 30).strip() and text[9] == "x" * 300_000


ARTICLE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header>Site name</header><nav><a href="/">menu</a></nav>
<div class="cookie-notice">we use cookies</div><div id="wrap"><aside>side</aside><div class="post-{n} content"><h1>Head {n}</h1>
<p>First &amp; <b>bold</b>   text {n} with <a href="x">a link</a> in a longer sentence.<p>Second&nbsp;paragraph {n}<br>after a break, unclosed
<script>var x = "</p>";</script><ul><li>one<li>two</ul><form><input><button>send</button></form><div class="comments"><p>a reader wrote this</p></div></div></div>
<footer>&copy; all rights</footer></body></html>"""


def test_article_without_the_rest(spark):
    rows = [(i, f"https://user@Host.example:80/{i}", ARTICLE.format(n=i)) for i in range(6)]
    rows.append((99, "https://host.example/99", '<html><body><div id="wrap"><div class="content post-7">thin</div></div><div class="other">' + "much longer text elsewhere " * 9 + "</div></body>"))
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"Head {i}\nFirst & bold text {i} with a link in a longer sentence.\nSecond paragraph {i} after a break, unclosed\none\ntwo"
    assert got[99] == "thin"  # its host's path wins over its own longest block


@pytest.mark.parametrize("page, text", [
    ("", ""), ("a &lt; b", "a < b"), ("<p>x<p>y", "x\ny"), ("<p title='a>b'>x</p>", "x"), ("<p title=don't>x</p>", "x"), ("<script>a", ""),
    ("<!-- c --><p>x<!-- d -->y</p>", "xy"), ("</div></p>x", "x"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<p>a<p hidden>b", "a"),
    ('<div style="overflow: hidden">seen</div>', "seen"), ('<p title="hidden gems">seen', "seen"), ("<p style='display: none'>a<p>b", "b"),
    ("<html><head><title>x</title><body><p>text", "text"), ("<head><meta charset=a>text", "text"), ("<p>a<span hidden>b<span>c</span>d</span>e", "ae"),
    ('<div class="article-comments"><p>no, no, no.</p></div><p>yes', "yes"), ('<div class="post-comments">no, no</div><p>yes', "yes"),
    ('<div class="main-menu">menu</div><p>yes', "yes"), ('<div class="elementor-widget-container"><p>all of it.</p></div>', "all of it."),
    ('<div class="page-with-sidebar"><p>all of it.</p></div>', "all of it."), ('<div id="sidebar-wrap"><article><p>it.</article><p>more of the same.</div>', "it."),
    ("<article><header><h1>T</h1><p>standfirst</p></header><p>body text.</p></article>", "T\nstandfirst\nbody text."),
    ("<form id=f><div><p>All of the page, in a form.</p></div></form>", "All of the page, in a form."), ("<p>the text, x.</p><form><p>your name</p></form>", "the text, x."),
    ("<p>a, b.<ul><li><a href=1>x</a><li><a href=2>y</a><li><a href=3>z</a></ul>", "a, b."), ("a <", "a <"), ("<p>1 < 2 <b", "1 < 2 <b"),
])
def test_broken_markup(page, text):
    assert extraction.Page(page).extract(None) == text


@pytest.mark.parametrize("part", [
    "<a ", "<div>x", "<div>", "<svg>", '<a x=">"', "<b>", "<", "&", "<!--", "</p>", "<p>a, b. ", "<td>x", "<li>a", "<section><h1>", "<p a=' b=\"", "<div class='a b'>x</div>", "</svg ",
])
def test_megabytes_of_broken_markup(part):
    """Time must be in proportion to the page: seconds for a megabyte, where squares of its length would take hours."""
    started = time.process_time()
    page = extraction.Page(part * ((1 << 20) // len(part)))
    page.extract(page.best())
    assert time.process_time() - started < 60


def test_host_vote_changes_what_a_page_gives(spark):
    """A page whose advert outweighs its short article follows the other pages of its host; alone, it would not."""
    usual = "<html><body><div class=top><p>{0}, an advert, read it.</p></div><div class=text><p>Article {0}, of some length.</p><p>And on, and on, and on, it goes.</p></div></body></html>"
    odd = "<html><body><div class=top><p>Buy, buy, buy, buy. It is cheap, it is good, it is yours.</p></div><div class=text><p>Brief</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", usual.format(i)) for i in range(5)] + [(9, "http://h.example/9", odd), (10, "http://other.example/", odd)]
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "Brief" and got[10].startswith("Buy") and got[3] == "Article 3, of some length.\nAnd on, and on, and on, it goes."
    paths = {r["host"]: (r["path"], r["n"]) for r in extraction.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert paths["h.example"] == ("/html/body/div.text", 6)


def test_query_equals_brute_force(spark):
    """All pages of the smallest tables against what stands between their article tags."""
    from rowkin.llm import queries

    got = {r["page_id"]: tuple(r) for r in queries.op7_extraction(spark, "/root/testdata/sf0.001").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p["html"] or "", re.S)
        parts = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", article[1].replace("<br>", " ")) if article else []
        texts = [" ".join(html.unescape(re.sub(r"</?(?:b|i|em|a)\b[^>]*>", "", x)).split()) for x in parts]
        text = "\n".join(x for x in texts if x)
        assert got[p["page_id"]] == (p["page_id"], p["url"], text, len(text))
