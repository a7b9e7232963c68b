"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level tags.  A block's features are its
word count and link density, those of the blocks before and after it, the
longest plain block nearby, its own kind of element (paragraph, heading, item
of a list), and two signs of place: whether an element around it is named or
tagged like a part beside the article, and whether it lies in an article or
outside, where articles hold a fair share of the page's words.  A decision tree,
grown by Gini impurity from the labelled pages below, says which blocks are
main text.  Each labelled page also stands in the table without its signs of
place, so the tree must do with words, links and neighbours where there are none.

A sign on an element says nothing where that element holds an unmarked article
or most of the page's words, as with classes of ``body`` or of a wrapper.

Scripts, styles, comments, forms' controls and hidden parts never become
blocks.  Character references are decoded, white space inside a block becomes
one blank, blocks are joined by an empty line.  A line break tag is white space.

Cases: null and empty pages give an empty text; a page without any tag is its text; unclosed tags and comments run
to the end of the page, as in browsers; time and memory grow in proportion to a page's length, however deep its elements are nested, and
a page is held whole; of equal shares at a leaf main text wins; null ids are like any other; empty tables give an empty result;
repeated rows give repeated rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import table

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)"""
    r"""|<(?P<raw>script|style|template|iframe|svg|annotation|annotation-xml|select|textarea|button|audio|video|title)\b(?:[^>"']*+(?:"[^"]*+"|'[^']*+')?+)*+>(?:.*?</(?P=raw)\s*>|.*\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>"""
    r"""|<[/!?a-z][^>]*>?""",
    re.IGNORECASE | re.DOTALL,
)
#: One attribute: its whole name, and its value if it has one; a match takes a value with its name, so nothing is looked for in values.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_BOILER_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "fieldset"))
#: Words in class, id and role that name a part beside the article.
_BOILER_WORDS = re.compile(
    r"(?:ads?|adv|advert\w*|adsense|banner\w*|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter\w*|subscri\w*|"
    r"signup|signin|login|register|share|sharing|social\w*|sidebar\w*|menus?|menubar|nav\w*|breadcrumbs?|footer\w*|masthead|topbar|toolbar|comment\w*|disqus\w*|"
    r"toc|respond|reply|replies|related\w*|recommend\w*|widgets?|pagination|pager|search|copyright|disclaimer|complementary|contentinfo|form)"
)

#: Of these words, those that mark an element inside an article by its id alone; others are names of chapters there.
_PART_IDS = re.compile(
    r"(?:ads?|adv|advert\w*|adsense|banner\w*|promo\w*|sponsor\w*|cookies?|consent|newsletter\w*|subscri\w*|share|sharing|sidebar\w*|nav\w*|breadcrumbs?|"
    r"footer\w*|comment\w*|disqus\w*|respond|replies|related\w*|recommend\w*|pagination|pager)"
)

#: Words before or after such a word in a name that turn it into a remark about the page.
_REMARKS = frozenset("no has have with without hide show is open closed enabled disabled off on".split())
_KINDS = {"p": "p", "pre": "p", "blockquote": "p", "li": "i", "dt": "i", "dd": "i"} | {f"h{n}": "h" for n in range(1, 7)}


@dataclass
class Block:
    text: str
    words: int
    links: float
    kind: str = "o"  # p, h, i as in _KINDS, or o
    marks: tuple[int, ...] = ()  # the innermost element around it that is named or tagged like boilerplate
    articles: tuple[int, ...] = ()  # the innermost article element around it
    main: bool = False


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    outer: dict[int, int] = field(default_factory=dict)  # each marked element, with the next one around it, 0 if none
    article_marks: dict[int, int] = field(default_factory=dict)  # each article, with the innermost mark on it or around it, 0 if none
    tags: int = 0


_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _attributes(attrs: str, inside: bool) -> tuple[bool, bool]:
    """Whether the attributes name a part beside the article, and hide the element; ``inside`` an article an id may be a chapter's."""
    mark = hidden = False
    for name, a, b, c in _ATTRIBUTE.findall(attrs):
        name = name.lower()
        if name not in ("class", "id", "role", "style", "hidden", "aria-hidden"):
            continue
        value = _HUMP.sub("-", a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
        elif name in ("class", "id", "role"):
            parts = _PART_IDS if inside and name == "id" else _BOILER_WORDS
            for one in value.split():
                words = [x for x in re.split(r"[^a-z0-9]+", one) if x]
                if not _REMARKS.intersection(words):
                    mark |= any(w == "header" and parts is _BOILER_WORDS or parts.fullmatch(w) for w in words)
    return mark, hidden


def page_of(html: str) -> Page:
    """The flat text blocks of a page, in order, and what is marked around them."""
    page = Page()
    # open elements: name, hidden, kind, marks, articles, main
    stack: list[tuple] = [("", False, "o", (), (), False)]
    parts: list[str] = []
    linked: list[str] = []
    in_link = False
    elements = 0
    opened: dict[str, int] = {}  # how many elements of a name are open

    def cut(to: int) -> None:
        for x in stack[to:]:
            opened[x[0]] -= 1
        del stack[to:]

    def flush() -> None:
        nonlocal in_link
        _, hidden, kind, marks, articles, main = stack[-1]
        words = "".join(parts).split()
        if words and not hidden:
            page.blocks.append(Block(" ".join(words), len(words), len("".join(linked).split()) / len(words), kind, marks, articles, main))
        parts.clear()
        linked.clear()
        in_link = False

    def add(text: str) -> None:
        if text:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                linked.append(text + " ")

    at = 0
    for m in _TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        name = m["name"]
        page.tags += 1
        if not name:
            continue
        name = name.lower()
        if name == "a":
            in_link = not m["end"]
        elif name == "br":
            parts.append(" ")
        elif name in _BLOCKS:
            flush()
            if m["end"]:
                if opened.get(name):
                    cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
            else:
                while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] in _CLOSES_ITSELF.get(name, ())):
                    cut(len(stack) - 1)
                if name in _VOID:
                    continue
                _, hidden, _, marks, articles, main = stack[-1]
                mark, gone = _attributes(m["attrs"], bool(articles) or main) if m["attrs"] else (False, False)
                elements += 1
                if (mark and name not in ("html", "body")) or name in _BOILER_TAGS or name == "header" and not articles:
                    page.outer[elements] = marks[0] if marks else 0
                    marks = (elements,)
                if name == "article":
                    articles = (elements,)
                    page.article_marks[elements] = marks[0] if marks else 0
                opened[name] = opened.get(name, 0) + 1
                stack.append((name, hidden or gone or name == "head", _KINDS.get(name, "o"), marks, articles, main or name == "main"))
    add(html[at:])
    flush()
    return page


#: What the tree looks at, in the order of the table's columns.
FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "plain_nearby", "paragraph", "heading", "item", "marked", "place",
)
#: Labelled pages, a line each, then ``=``.  A block is its kind (p, h, i, o), words, percent of them in links, signs of place
#: (a in an article, x marked), and + for main text or - for other.  Pages of the first group also serve with the signs of one kind
#: and with none, those of the second also without marks; blank lines part the groups.
LABELLED = """
news = i1,100x- i1,100x- i2,100x- o9,0x- h8,0a+ p45,0a+ p3,0a+ p80,5a+ p1,0a+ p30,0a+ p2,0a+ o8,20x-
notes = i2,100x- i1,100x- i3,100x- o6,0x- h4,0a+ p1,0a+ p2,0a+ p60,0a+ p2,0a+ o12,10x-
report = o2,100x- o2,100x- o3,0x- h9,0a+ p25,0a+ h3,0a+ p120,2a+ i8,0a+ i12,0a+ i6,0a+ p40,0a+ h2,0a+ p90,0a+ o5,80x- o4,0x-
guide = i1,100x- i2,100x- h6,0a+ p35,10a+ i15,0a+ i20,30a+ i9,0a+ p50,0a+ p16,40a+ p70,0a+ i3,100x- i4,100x- i2,100x- o10,30x-
blog = o1,100x- o1,100x- o5,0x- h7,0a+ o60,3a+ o45,0a+ o14,0a+ o90,5a+ o70,0a+ o3,100x- o2,100x- o6,0x-
column = o2,100x- o1,100x- h10,0a+ o110,0a+ o8,0a+ o75,0a+ o40,10a+ o2,100x- o4,100x- o9,60x-
table = i1,100x- i1,100x- h5,0a+ p55,0a+ o12,0a+ o18,0a+ o40,0a+ p65,0a+ o7,50x-
index = i2,100x- i2,100x- i3,100x- h2,0x- i6,100x- i8,100x- i7,100x- h3,100x- i5,90x- o4,0x- o6,40x-
shop = i1,100x- i2,100x- o3,0x- o2,100x- o5,60x- o4,100x- o2,0x- o6,50x- i3,100x- o8,0x-
bare = h6,0a+ p50,0a+ p20,0a+ p3,0a+
open = i1,100x- i2,100x- h6,0a+ p50,0a+ p12,0a+ p44,0a+
flat = o80,0a+ o60,0a+ o30,0a+ o22,0a+ o70,0a+
first = p18,0a+ p40,0a+ p2,0a+ i7,0a+ i9,0a+ p6,0a+
short = p4,0a+
home = o2,100x- o45,0a+ o60,0a+ o40,5a+ o9,0x-
promo = i1,100x- i1,100x- o7,0x- h10,0a+ p25,0a+ p60,0a+ p2,0a+ o11,0x-
spot = o1,100x- o11,0x- h6,0a+ p30,0a+ p30,0a+ o8,0x-
line = i2,100x- i1,100x- o5,0x- h12,0a+ p3,0a+ p16,0a+ p28,0a+ o13,0x-
pair = i1,100x- o13,0x- h8,0a+ o50,0a+ o20,0a+ o44,0a+ o6,0x-
page = o2,100x- o50,0a+ o4,0x-
poem = o1,100x- o2,100x- o5,0x- h4,0a+ p6,0a+ p7,0a+ p5,0a+ p8,0a+ o7,0x-
letter = o3,100x- o1,100x- p30,0a+ p12,0a+ p60,0a+ o14,0x-
plain = i1,100x- i1,100x- h5,0a+ p9,0a+ p15,0a+ p7,0a+ p11,0a+ o12,0x-
story = o4,100x- o12,0x- h7,0a+ p90,0a+ p33,0a+ p140,0a+ p8,0a+ o16,0x-
wire = o1,100x- o1,100x- h9,0a+ p21,0a+ p17,0a+ o5,0x-
long = h3,0a+ p5,0a+ p7,0a+ p240,5a+ p11,0a+ h4,0a+ p8,0a+ p6,0a+ p190,0a+

talk = i1,100x- h8,0a+ p60,0a+ p20,0a+ p90,0a+ h2,0x- p25,0x- p60,0x- p8,0x- p40,10x- o2,0x- o8,20x-
teaser = i1,100x- h7,0+ p80,5+ p45,0+ p15,0+ p120,0+ h4,100a- p12,0a- o2,100a- o9,0x-
cards = h6,0+ o70,0+ p60,0+ p9,0+ p85,5+ p30,0+ h3,100a- p10,50a- h4,100a- p14,40a- o8,30x-
faq = i2,100x- h3,0a+ h6,0a+ p30,0a+ h7,0a+ p22,0a+ i5,0a+ i4,0a+ h5,0a+ p9,0a+ p18,0x- o5,0x- p12,0x- o11,0x-
notice = p22,5x- o20,0x- p14,0x- h9,0a+ p65,0a+ p33,0a+ p7,0a+ p48,0a+ p16,0x- o3,100x- h3,0x- p28,0x- p9,0x-
last = i1,100x- h6,0a+ p50,0a+ o6,0a+
ends = i2,100x- h3,0a+ o30,0a+ p70,0a+ i9,0a+ o2,0a+
side = h2,0x- o9,0x- h6,0a+ o40,0a+ o3,0a+ p50,0a+ o4,0a+ p2,0a+ o5,0x- h2,0x- p11,0x- o30,0x- i4,0x- i6,0x-

inside = i1,100x- h8,0a+ p50,0a+ o25,0ax- p70,0a+ p12,0ax- p4,0a+ o2,0ax- h2,0ax- p30,0ax- p55,0ax- o7,0x-
stand = o12,0x- h5,0a+ p40,0a+ o6,0a+ p80,0a+ o15,0ax- p5,0a+ o9,0a+ h3,0a+ p20,0a+ h2,0ax- i7,100ax- i6,100ax- i8,100ax- p20,0x-
cells = i1,100x- h4,0a+ o2,0a+ o3,0a+ o1,0a+ o4,0a+ p35,0a+ p6,100a+ p50,60a+ h3,100a+ p40,0a+ i6,100a- i3,100a- o9,0x-
marked = p20,0x- p60,0x- h4,0x- p15,0x- o80,0x- h6,0+ p50,0+ o30,0+ p9,0+ p44,0x- i6,0x- i20,0x- o150,0x-
"""
_ENTRY = re.compile(r"([phio])(\d+),(\d+)(a?)(x?)([+-])")


@dataclass
class Node:
    """A leaf has ``share`` only; others send values up to ``bound`` left."""

    share: float
    feature: int = -1
    bound: float = 0.0
    left: Node | None = None
    right: Node | None = None


def labelled_table(scales: tuple[float, ...] = (0.5, 0.75, 1.0, 1.4, 2.0)) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled pages, at several lengths of their blocks, with and without signs of place."""
    rows, labels = [], []
    every, outside, signed = LABELLED.strip().split("\n\n")
    for group, signs in ((every, "ax"), (every, "a"), (every, "x"), (every, ""), (outside, "ax"), (outside, "a"), (signed, "ax")):
        for line in group.splitlines():
            found = _ENTRY.findall(line.partition(" = ")[2])
            for scale in scales:
                page = Page()
                for i, (kind, words, links, a, x, _) in enumerate(found):
                    n = int(words) if int(words) < 4 else round(int(words) * scale)
                    page.blocks.append(Block("", n, int(links) / 100, kind, (i + 1,) if x and "x" in signs else (), (0,) if a and "a" in signs else ()))
                rows += rows_of(page)
                labels += [float(x[-1] == "+") for x in found]
    return np.array(rows, float), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 3) -> Node:
    """A binary tree by the split of least Gini impurity; ties go to the first feature and bound; leaves have ``least`` rows or more."""
    share = float(y.mean()) if len(y) else 0.0
    best = (2 * share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    if depth and 0 < share < 1:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for bound in (values[1:] + values[:-1]) / 2:
                parts = [y[x[:, f] <= bound], y[x[:, f] > bound]]
                if min(map(len, parts)) < least:
                    continue
                impurity = sum(2 * p.mean() * (1 - p.mean()) * len(p) for p in parts)
                if impurity < best[0] - 1e-12:
                    best = (impurity, f, float(bound))
    if best[1] < 0:
        return Node(share)
    low = x[:, best[1]] <= best[2]
    return Node(share, best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def is_main(node: Node, row: tuple) -> bool:
    while node.feature >= 0:
        node = node.left if row[node.feature] <= node.bound else node.right
    return node.share >= 0.5


def standing_marks(page: Page, most: float = 0.5) -> set[int]:
    """The marked elements that hold neither an unmarked article nor more than ``most`` of the page's words, and those within them."""
    total = sum(b.words for b in page.blocks)
    held = dict.fromkeys(page.outer, 0)
    for b in page.blocks:
        for x in b.marks:
            held[x] = held.get(x, 0) + b.words
    for x in sorted(page.outer, reverse=True):  # an element's number is greater than those around it
        if page.outer[x]:
            held[page.outer[x]] += held[x]
    stand = {x for x, n in held.items() if n <= most * total or x in page.article_marks and n < total}
    # from the inside out: no mark stands around an article that has none of its own
    cleared: set[int] = set()
    for article, x in sorted(page.article_marks.items(), reverse=True):
        if x == article:
            if x in stand:
                continue
            x = page.outer[x]
        while x and x not in cleared:
            cleared.add(x)
            stand.discard(x)
            x = page.outer[x]
    for x in sorted(page.outer):
        if page.outer[x] in stand:
            stand.add(x)
    return stand


def rows_of(page: Page) -> Iterator[tuple]:
    """The features of each block; an article counts before ``main``, and that where there is no article."""
    blocks = page.blocks
    if not blocks:
        return
    stand = standing_marks(page)
    marked = [not stand.isdisjoint(b.marks) for b in blocks]
    inside = [bool(b.articles) and not m for b, m in zip(blocks, marked, strict=True)]
    if not any(inside):
        inside = [b.main and not m for b, m in zip(blocks, marked, strict=True)]
    plain = [b.words if b.links < 0.34 and not m else 0 for b, m in zip(blocks, marked, strict=True)]
    share = sum(n for n, i in zip(plain, inside, strict=True) if i) / max(1, sum(plain))
    telling = share >= 0.4  # teasers alone tell nothing
    edge = Block("", 0, 0.0)
    for i, (before, b, after) in enumerate(zip([edge, *blocks[:-1]], blocks, [*blocks[1:], edge], strict=True)):
        near = max(max(plain[max(0, i - 3) : i], default=0), max(plain[i + 1 : i + 4], default=0))
        yield (
            b.words, b.links, before.words, before.links, after.words, after.links, near, b.kind == "p", b.kind == "h", b.kind == "i",
            marked[i], (1 if inside[i] else -1) if telling else 0,
        )


def main_text(html: str | None, tree: Node) -> str:
    page = page_of(html or "")
    if not page.tags:  # plain text
        return "\n\n".join(b.text for b in page.blocks)
    return "\n\n".join(b.text for b, row in zip(page.blocks, rows_of(page), strict=True) if is_main(tree, row))


def main_text_column(html_col: str = "html", tree: Node | None = None) -> Column:
    tree = tree or grow(*labelled_table())

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p, tree) for p in pages], dtype=object)

    return extract.asNondeterministic()(F.col(html_col))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: ``id_col``, the ``keep`` columns, ``text`` and ``n_chars``, its code points."""
    return pages.select(id_col, *keep, main_text_column(html_col).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
