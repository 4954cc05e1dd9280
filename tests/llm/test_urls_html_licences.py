"""URL filter, text extraction and licence scan."""

import random

import pytest

from koine.llm import html_text, license_scan, url_filter

PAGE = "page_id long, url string, html string, host string, path string, rule string, node string, root string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "a", "b", "c", "d", "e") for i, u, h in rows], PAGE)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in host), path


def own_rule(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), a == "allow", h + p, a) for a, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


URLS = [
    "http://A.Example.ORG/es/5", "https://b.example.org/en/148.html#x", "https://example.org/en/25?x=/en/1", "http://x.com/de/1?a", "http://y.com/fr/2", "http://z.net/", "http://z.net",
    "http://norg/es/", "ftp://org/x://y", "nothing", "", None, "http://com/de/", "http://a.com?/de/", "http://ünï.COM/de/ß", "://com/de/", "http:///com/de/", "http://q.net/a b",
]


def test_rules_without_links(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(0, URLS[0], "")]
    got = sorted(tuple(r) for r in url_filter.filter_urls(pages(spark, rows), spark.createDataFrame(url_filter.RULES, "action string, host string, path string")).drop("alias_root").collect())
    expected = sorted((i, *parts(u), own_rule(u, url_filter.RULES)[0], own_rule(u, url_filter.RULES)[1] or "allow") for i, u, _ in rows)
    assert [(a, b, c, d or "", e) for a, b, c, d, e in got] == [(a, b, c, d or "", e) for a, b, c, d, e in expected]


def test_aliases_against_brute_force(spark):
    rng = random.Random(4)
    rules = [("block", "bad.net", "/"), ("allow", "good.net", "/"), ("block", "mixed.net", "/x"), ("block", None, "/"), ("allow", "n.net", None)]
    sites = [f"http://s{k}.info/p{k}" for k in range(25)] + ["http://bad.net/a", "http://good.net/b", "http://mixed.net/x1", "https://mixed.net/y"]
    rows, edges = [], []
    for i, u in enumerate(sites):
        html = "<p>no link</p>"
        if rng.random() < 0.6:
            to = rng.choice(sites)
            edges.append((u, to))
            html = rng.choice([f'<head><link rel="canonical" href="{to}"></head>', f"<LINK href='{to}' REL=canonical>", f'<meta http-equiv="refresh" content="0; url={to}">'])
        rows.append((i, u + rng.choice(["", "#f"]), html))
    extra = [("http://s1.info/p1", "http://bad.net/zzz"), ("http://s2.info/p2", "http://elsewhere.net/"), (None, "http://bad.net/a"), ("http://s3.info/p3", "nothing")]
    key = lambda u: u.split("://", 1)[1].split("#")[0]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    members = {}
    for a, b in [*edges, *extra[:2]]:
        up[find(key(a))] = find(key(b))
    for u in {*sites, *(b for _, b in extra[:2])}:
        members.setdefault(find(key(u)), []).append(u)
    plain = [r for r in rules if None not in r]

    def verdict(u):
        own = own_rule(u, plain)[1]
        if own:
            return own
        acts = {own_rule(x, plain)[1] for x in members.get(find(key(u)), [])}
        return "allow" if "allow" in acts else "block" if "block" in acts else "allow"

    out = url_filter.filter_urls(pages(spark, rows), spark.createDataFrame(rules, "action string, host string, path string"), spark.createDataFrame(extra, "from_url string, to_url string"))
    got = {r["page_id"]: r["verdict"] for r in out.collect()}
    assert got == {i: verdict(u.split("#")[0]) for i, u, _ in rows}
    assert "block" in got.values()


def test_relative_links(spark):
    rows = [(1, "https://a.info/x/y?z", '<link rel=canonical href="/de/2">'), (2, "https://a.info/x/", '<link rel=canonical href="w">'), (3, "http://a.info", '<link rel=canonical href="//b.info/q?a=1&amp;b=2">')]
    got = {r["from_url"]: r["to_url"] for r in url_filter.links(pages(spark, rows)).collect()}
    assert got == {"https://a.info/x/y?z": "https://a.info/de/2", "https://a.info/x/": "https://a.info/x/w", "http://a.info": "http://b.info/q?a=1&b=2"}


ARTICLE = "<h1>Head &amp; line</h1><p>First paragraph, with commas, of some   length.\n It goes on.</p><p>Short.<ul><li>one<li>two</ul><p>Third <b>bold</b> paragraph&nbsp;here, it ends."
FURNITURE = {
    "nav": '<nav><a href="/">Home</a> <a href="/x">News, today.</a></nav>',
    "ad": '<div class="ad">Buy this, now. It is good.</div>',
    "cookie": '<div id="cookie-notice"><p>We use cookies, as ever. Agree?</p></div>',
    "form": "<form><p>Your name, please.</p><input></form>",
    "aside": "<aside><p>Related stories, and more of them.</p></aside>",
    "script": '<script>var t="</p>, x.";</script><style>p{margin:0}</style><!-- a comment, here. -->',
    "comments": '<section class="comments"><p>Great, I liked it. Thanks!</p></section>',
    "hidden": '<div style="display: none">Not seen, ever.</div>',
    "footer": "<footer>&copy; 2020, somebody. All rights.</footer>",
}
TEXT = "Head & line\nFirst paragraph, with commas, of some length. It goes on.\nShort.\none\ntwo\nThird bold paragraph here, it ends."


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main><div>{}</div></main>", '<div id="wrap" class="has-sidebar"><div class="content">{}</div></div>'])
@pytest.mark.parametrize("inside", [True, False])
def test_article_among_furniture(shell, inside):
    junk = list(FURNITURE.values())
    body = shell.format(ARTICLE + "".join(junk)) if inside else "".join(junk[:5]) + shell.format(ARTICLE) + "".join(junk[5:])
    page = f"<!DOCTYPE html><html><head><title>T, t.</title><meta charset=utf-8></head><body>{body}</body></html>"
    assert html_text.extract(page) == TEXT


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("   \n", ""), ("just text", "just text"), ("<p>a<br>b</p>", "a\nb"), ("<article><p>One, two.</p><foot", "One, two."), ("<script>x", ""), ("<div>a &lt;b&gt; &#233;&amp;amp;</div>", "a <b> é&amp;"),
        ('<article><p title="a>b">x, y.</p></article>', "x, y."), ("<article></article><nav>menu</nav>", ""), ("<p>" + "word, " * 20000 + "</p>", ("word, " * 20000).strip()), ("</p></div>text, here.", "text, here."), ("a < b, c", "a < b, c"),
    ],
)
def test_pages_of_odd_form(page, text):
    assert html_text.extract(page) == text


@pytest.mark.parametrize("junk", ["<div>", "<b>", "<p>", "</x>", "<li>", "<table><tr><td>", "<a href=x>", "<", "&", "<!--", "<div class='", "<p title=\"a>"])
def test_deep_and_broken_pages_take_linear_time(junk):
    page = f"<article><p>Some text, here. It is long enough.</p>{junk * 40_000}word, word.</article>"
    assert isinstance(html_text.extract(page), str)


def test_main_text_frame(spark):
    rows = [(1, None, None), (2, "u", "<p>é, x.</p>"), (2, "u", "<p>é, x.</p>"), (None, "v", "")]
    got = sorted((tuple(r) for r in html_text.main_text(pages(spark, rows)).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (2, "u", "é, x.", 5), (2, "u", "é, x.", 5), (None, "v", "", 0)], key=str)
    assert html_text.main_text(spark.createDataFrame([], PAGE)).count() == 0 and url_filter.filter_urls(spark.createDataFrame([], PAGE), spark.createDataFrame([], "action string, host string, path string")).count() == 0


BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted. Redistributions of source code must retain the above. Redistributions in binary form must reproduce it."
LICENCES = [
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", 1),
    ("junk $$$\nReleased under the MIT License.", "MIT", 1),
    ("Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at", "Apache-2.0", 3),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC", 1),
    (BSD, "BSD-2-Clause", 3),
    (BSD + " Neither the name of X nor Y may be used to endorse or promote products. SPDX-License-Identifier: MIT", "BSD-3-Clause,MIT", 5),
    ("A licence to kill, with a copyright.", "", 0),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy. The above copyright notice and this permission notice shall be included. The software is provided \"as is\", without warranty.", "MIT", 3),
    (None, "", 0), ("", "", 0), ("word " * 30000 + "Released under the MIT License. " + "word " * 30000, "MIT", 1),
]


def test_licences(spark):
    rows = [(i, t, "x", "y") for i, (t, _, _) in enumerate(LICENCES)] * 2
    got = sorted((r["doc_id"], r["licences"], r["n_sentences"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, licences string, _t string")).collect())
    assert got == sorted([(i, name, n) for i, (_, name, n) in enumerate(LICENCES)] * 2)
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licence_plan_is_native(spark):
    df = license_scan.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
