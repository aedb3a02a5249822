"""Main text keeps what stands beside the deepest container."""

from rowkin.llm import extraction

PAGE = "<html><body><article><h1>Head {n}</h1><p>lead {n}</p><div class=body>" + "<p>a long running text of the article</p>" * 40 + "</div></article></body></html>"


def test_headline_and_lead_beside_the_body(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(n=i)) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join([f"Head {i}", f"lead {i}", *["a long running text of the article"] * 40]) for i in range(4)}


def test_page_votes_for_the_deepest_of_equals():
    assert extraction.Page(PAGE.format(n=1)).best() == "/html/body/article"
    assert extraction.Page("<html><body><div><p>x</div></body></html>").best() == "/html/body/div"
    assert extraction.Page("<p><a href=x>y</a>").best() is None
