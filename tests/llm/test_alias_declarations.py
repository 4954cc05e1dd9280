"""Pages with several alias declarations, in the forms that browsers accept."""

from koine.llm import url_filter

PAGES = [
    ("https://p.info/1", """<link rel=canonical href="https://p.info/x"><link rel="canonical" href="https://a.com/de/1"/>""", {"https://p.info/x", "https://a.com/de/1"}),
    ("https://p.info/2", """<!-- <link rel="canonical" href="https://old.info/"> --><link rel="canonical" href="https://a.com/de/2">""", {"https://a.com/de/2"}),
    ("https://p.info/3", """<meta http-equiv="refresh" content="0; url='https://a.com/de/3'">""", {"https://a.com/de/3"}),
    ("https://p.info/4", """<meta content='5;URL="https://a.com/de/4"' http-equiv=refresh>""", {"https://a.com/de/4"}),
    ("https://p.info/5", """<link href='https://a.com/de/5' rel="alternate canonical">""", {"https://a.com/de/5"}),
    ("https://p.info/6", """<meta http-equiv=refresh content="9;url=https://p.info/y"><META HTTP-EQUIV="Refresh" CONTENT="0;URL=https://a.com/de/6">""", {"https://p.info/y", "https://a.com/de/6"}),
    ("https://p.info/7", """<link rel="non-canonical" href="https://a.com/de/7"><link rel=stylesheet href=canonical.css>""", set()),
]


def test_all_declarations_become_edges_and_block(spark):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(PAGES)], "page_id long, url string, html string")
    got = {}
    for r in url_filter.links(pages).collect():
        got.setdefault(r["from_url"], set()).add(r["to_url"])
    assert got == {u: to for u, _, to in PAGES if to}
    rules = spark.createDataFrame([("block", "a.com", "/de/")], "action string, host string, path string")
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, rules).collect()}
    assert verdicts == {i: "block" if to else "allow" for i, (_, _, to) in enumerate(PAGES)}
