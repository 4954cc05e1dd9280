"""Main-text extraction by tag-path ratios.

A page becomes a sequence of blocks of text with their root-to-leaf tag paths
(containers with their classes).  For every path the text length and the
punctuation per block are aggregated; each block takes its path's two ratios,
the sequences are smoothed over neighbouring blocks and fused by their geometric
mean.  Paths are then judged against the text's average: strong ones are the
core; inside the smallest element around the core weaker paths, headings and
lists are content too, outside it only paths that are strong by themselves.

Menus, footers, scripts and the like are left out by their tags.  A telling
class or id (``sidebar``, ``comments``) and a high share of links only lower a
path's ratios, and a name is disregarded where nearly all of a page's text bears
it.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from koine.llm.tables import table
from koine.llm.text import releasing

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
FURNITURE = frozenset("nav header footer aside button select menu dialog option object canvas audio video head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTED = HEADINGS | frozenset("li pre blockquote td th dd dt figcaption caption".split())
#: Elements whose class is part of their paths.
CONTAINERS = frozenset("section div ul ol dl table td".split())
#: Start tags that end an open element of the listed kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = frozenset("ul ol table dl select".split())
ROOTS = frozenset("html body main article".split())
ROLES = re.compile(r"^(navigation|banner|contentinfo|complementary|search|form|alert|alertdialog|dialog|menu|menubar|toolbar)$")
_WORD = (
    r"nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|side|aside|footer|foot|header|masthead|topbar|banner|ads?|adverts?|advertisement|adsense|sponsor(?:ed|s)?|"
    r"promo(?:tion)?s?|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|subscription|signup|login|social|shar(?:e|ing)|related|recommend(?:ed|ations)?|"
    r"comments?|commentlist|disqus|respond|repl(?:y|ies)|widgets?|toolbar|pagination|pager|skip|search|copyright|legal"
)
FURNITURE_NAME = re.compile(rf"^(?:(?!has-|has_|with-|with_|no-|no_)[a-z0-9]+[-_])*?(?:{_WORD})(?:[-_].*|\d*)$")
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[a-zA-Z/!?][^>]*\Z""",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PUNCT = re.compile(r"[.,;:!?。、，；：！？…—]")
_DIGITS = re.compile(r"\d+")
KERNEL = np.array([0.05, 0.25, 0.4, 0.25, 0.05])
#: What a telling name leaves of a path's ratio, and what text made of links only leaves.
NAMED, LINKED = 0.1, 0.1
#: Shares of the average ratio: of the core, of paths inside the element around it, of paths elsewhere.
CORE, INSIDE, ELSEWHERE = 0.7, 0.3, 0.5
#: Names count for nothing if less than this share of the text is without them, for elements of this many characters.
UNNAMED, NAMED_LEAST = 0.1, 200


class Node:
    """A run of text: its block, the block element around it, that one's path
    and tag, and the innermost element of a telling name around it."""

    __slots__ = ("text", "block", "element", "path", "leaf", "link", "named")

    def __init__(self, text: str, block: int, element: int, path: int, leaf: str, link: bool, named: int):
        self.text, self.block, self.element, self.path, self.leaf, self.link, self.named = text, block, element, path, leaf, link, named


class _Open:
    """An open element, with what it takes from those around it."""

    __slots__ = ("tag", "number", "furniture", "article", "link", "named", "block")

    def __init__(self, tag: str, number: int, furniture: bool, article: bool, link: bool, named: int, block: tuple[int, int, str]):
        self.tag, self.number, self.furniture, self.article, self.link, self.named = tag, number, furniture, article, link, named
        #: Number, path and tag of the block element here or around.
        self.block = block


class Page:
    """A parsed page: text in order, each element's parent, and for elements of a
    telling name the next one around (0: none)."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.parent = [-1]
        self.named: dict[int, int] = {}


def _kind(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool, str]:
    """Whether an element is furniture, whether its name tells so, and its class."""
    if tag in FURNITURE and not (tag == "header" and in_article):
        return True, False, ""
    named, own = tag == "form", ""
    if not attrs or tag in ROOTS:
        return False, named, own
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).strip().lower()
        if name in ("class", "id") and any(FURNITURE_NAME.match(x) for x in value.split()):
            named = True
        if name == "class" and tag in CONTAINERS:
            own = _DIGITS.sub("", value)
        if name == "role" and ROLES.match(value) or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False, ""
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False, ""
    return False, named, own


def parse(page: str) -> Page:
    """The text of a page outside furniture.

    Each tag costs the elements it closes, however deep the page is nested.
    """
    out = Page()
    nodes, parent = out.nodes, out.parent
    paths: dict[tuple[int, str, str, int], int] = {}
    stack = [_Open("", 0, False, False, False, 0, (0, 0, ""))]
    opened: Counter[str] = Counter()
    block, at, size = 0, 0, len(page)
    lower = None

    def push(text: str) -> None:
        top = stack[-1]
        if text and not top.furniture:
            nodes.append(Node(text, block, *top.block, top.link, top.named))

    def pop_to(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    def nearest(wanted: Callable[[str], bool], stop: Callable[[str], bool] = lambda t: False) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if wanted(stack[k].tag):
                return k
            if stop(stack[k].tag):
                return 0
        return 0

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            push(page[at:])
            break
        push(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if m["tag"] and m["end"] or m["tag2"] and m["end2"]:
            block += not inline
            if opened[tag] > 0 and (k := nearest(lambda t: t == tag)):
                if inline:  # elements opened inside stay open
                    opened[tag] -= 1
                    del stack[k]
                else:
                    pop_to(k)
            continue
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        if tag in RAW:
            if tag in ("svg", "math") and attrs.endswith("/"):
                continue
            if lower is None:
                lower = page.lower()
            close = lower.find(f"</{tag}", at)
            if close < 0:
                break
            gt = page.find(">", close)
            at = size if gt < 0 else gt + 1
            block += tag in ("textarea", "title")
            continue
        block += not inline
        if tag in VOID:
            continue
        if tag == "body":
            if opened["head"] > 0:
                pop_to(nearest(lambda t: t == "head"))
        elif not inline:
            if opened["p"] > 0 and (k := nearest(lambda t: t not in INLINE)) and stack[k].tag == "p":
                pop_to(k)
            ends = ENDS.get(tag, ())
            if any(opened[t] > 0 for t in ends) and (k := nearest(lambda t: t in ends, BARRIERS.__contains__)):
                pop_to(k)
            if stack[-1].tag == "head" and tag in ("article", "main", "section", "div", "p"):
                pop_to(len(stack) - 1)
        top, number = stack[-1], len(parent)
        parent.append(top.number)
        furniture, telling, own_class = _kind(tag, attrs, top.article)
        named = top.named
        if telling:
            out.named[number], named = top.named, number
        own = top.block if inline else (number, paths.setdefault((top.block[1], tag, own_class, named), len(paths) + 1), tag)
        opened[tag] += 1
        stack.append(_Open(tag, number, top.furniture or furniture, top.article or tag in ("article", "main"), top.link or tag == "a", named, own))
    return out


def _blocks(nodes: list[Node]) -> list[tuple[str, Node]]:
    """Texts of blocks, decoded and with single spaces, empty ones left out."""
    out: list[tuple[list[str], Node]] = []
    last = None
    for n in nodes:
        if n.block != last:
            out.append(([], n))
            last = n.block
        out[-1][0].append(n.text)
    texts = ((" ".join(entities.unescape("".join(parts)).split()), n) for parts, n in out)
    return [(t, n) for t, n in texts if t]


def _smooth(x: np.ndarray) -> np.ndarray:
    padded = np.pad(x, 2, mode="edge")
    return np.convolve(padded, KERNEL, mode="valid")


def _suspects(blocks: list[tuple[str, Node]], named: dict[int, int]) -> set[int]:
    """Elements whose telling name counts, with those inside them: all, but for
    those that hold nearly all of the page's text."""
    own: dict[int, float] = defaultdict(float)
    for t, n in blocks:
        own[n.named] += len(t) * (1 - 0.9 * n.link)
    total = sum(own.values())
    chains = {e: [] for e in own}
    for e in own:
        x = e
        while x:
            chains[e].append(x)
            x = named[x]
    counted = {x for c in chains.values() for x in c}
    while counted:
        free = sum(v for e, v in own.items() if not counted.intersection(chains[e]))
        if free >= UNNAMED * total:
            break
        outer: dict[int, float] = defaultdict(float)
        for e, v in own.items():
            last = [x for x in chains[e] if x in counted]
            if last:
                outer[last[-1]] += v
        most = max(outer, key=lambda x: (outer[x], -x))
        if free and outer[most] < NAMED_LEAST:
            break
        counted.discard(most)
    return {e for e, c in chains.items() if counted.intersection(c)}


def path_ratios(blocks: list[tuple[str, Node]]) -> tuple[dict[int, float], dict[int, float]]:
    """Characters per block and punctuation per block of every path."""
    length, punct, count = defaultdict(float), defaultdict(float), defaultdict(int)
    for t, n in blocks:
        length[n.path] += len(t)
        punct[n.path] += len(_PUNCT.findall(t))
        count[n.path] += 1
    return {p: length[p] / count[p] for p in length}, {p: (punct[p] + 0.1) / count[p] for p in length}


def content(blocks: list[tuple[str, Node]], page: Page) -> list[str]:
    """The blocks that belong to the article."""
    if not blocks:
        return []
    suspects = _suspects(blocks, page.named)
    length, linked = defaultdict(float), defaultdict(float)
    doubt: dict[int, float] = {}
    for t, n in blocks:
        length[n.path] += len(t)
        linked[n.path] += len(t) * n.link
        doubt[n.path] = NAMED if n.named in suspects else 1.0
    text_ratio, punct_ratio = path_ratios(blocks)
    trust = {p: doubt[p] * (1 - (1 - LINKED) * linked[p] / length[p]) for p in length}
    own = {p: (text_ratio[p] * punct_ratio[p]) ** 0.5 * trust[p] for p in length}
    paths = [n.path for _, n in blocks]
    fused = np.sqrt(_smooth(np.array([text_ratio[p] for p in paths])) * _smooth(np.array([punct_ratio[p] for p in paths])))
    smooth: dict[int, float] = defaultdict(float)
    for (t, n), f in zip(blocks, fused.tolist(), strict=True):
        smooth[n.path] += f * trust[n.path] * len(t) / length[n.path]
    # the average over the text that is in no doubt
    sure = [p for p in length if doubt[p] == 1.0] or list(length)
    average = sum(own[p] * length[p] for p in sure) / sum(length[p] for p in sure)
    core = {p for p in length if own[p] >= CORE * average}
    under = [0] * len(page.parent)
    for _, n in blocks:
        under[n.element] += n.path in core
    for e in range(len(page.parent) - 1, 0, -1):  # parents have smaller numbers
        under[page.parent[e]] += under[e]
    around = max(e for e, c in enumerate(under) if c == under[0])
    inside = [False] * len(page.parent)
    for e in range(len(page.parent)):
        inside[e] = e == around or e > 0 and inside[page.parent[e]]

    def wanted(n: Node) -> bool:
        p = n.path
        if own[p] >= ELSEWHERE * average:
            return True
        return inside[n.element] and (smooth[p] >= INSIDE * average or n.leaf in LISTED and doubt[p] == 1.0 and linked[p] < 0.5 * length[p])

    out, kept = [], False
    for t, n in reversed(blocks):
        # a heading goes with what follows it
        kept = wanted(n) or kept and n.leaf in HEADINGS and doubt[n.path] == 1.0
        if kept:
            out.append(t)
    return out[::-1]


def extract(page: str | None) -> str:
    """The main text of a page; empty for null, empty or text-free pages."""
    if not page:
        return ""
    parsed = parse(page)
    return "\n".join(content(_blocks(parsed.nodes), parsed))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``.

    Null html gives the empty text; a null url or id stays null; repeated rows
    give repeated results, other columns are not read, an empty table gives an
    empty result.  Blocks of equal ratios are treated alike.  The time for a page
    grows with its length, whatever its nesting.  One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = [extract(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select(id_col, url_col, html_col).mapInArrow(releasing(run), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
