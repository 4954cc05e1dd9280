"""Articles in several parts, outside the element that holds most of them."""

from koine.llm import html_text

LONG = ["A paragraph of the body, number %d, with commas, that goes on for a while. It ends here." % k for k in range(12)]
LEAD, END = "The lead, which says what it is about, in a sentence.", "The conclusion, which says it again, in a sentence."


def p(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_lead_and_conclusion():
    page = f"<html><body><nav>Home, about.</nav><div id=c><h1>Title</h1><p>{LEAD}</p><div class=body>{p(LONG)}</div><p>{END}</p></div><footer>2020, all rights.</footer></body></html>"
    assert html_text.extract(page) == "\n".join(["Title", LEAD, *LONG, END])


def test_sibling_parts():
    for tag in ("article", "section"):
        page = f"<html><body><nav>Home, about.</nav><div><{tag}>{p(LONG)}</{tag}><{tag}><h2>More</h2><p>{END}</p></{tag}></div></body></html>"
        assert html_text.extract(page) == "\n".join([*LONG, "More", END])
