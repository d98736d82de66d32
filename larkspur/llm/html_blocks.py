"""Main text of HTML pages from flat text blocks.

A page is cut into blocks of text at block-level tags. Each block has its word count and link
density and those of its neighbours, and marks of where it stands: in an element that names
boilerplate or an article, or in a heading. A decision tree, grown from a small labelled table,
tells article text from the rest: marks decide where a page has them, counts and densities of
the block and its neighbours where it has none.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import with_added

# HTML elements by role.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CODE_TAGS = frozenset(("script", "style"))
SKIPPED_TAGS = CODE_TAGS | frozenset("noscript template iframe object svg math canvas audio video title textarea button select datalist".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form header menu dialog".split())
BOILERPLATE_WORDS = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus discussion footer footnav form header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply replies respond responses share sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar topbar widget".split())
#: A name that begins with one of these says what the element has or lacks, not what it is.
HAVING_WORDS = frozenset("no not without has have having with hide show is supports enable enabled disable".split())
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_WORDS = frozenset("article content entry story post body main text".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose start ends an open element of the same list.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Attributes as browsers read them; a quote that is not closed before white space, / or > is part of the text around it.
ATTRIBUTES = r"""(?:[\s/]+|[^\s/>][^\s/>=]*+(?:\s*=\s*(?:"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>])|"[^"<>]*"|'[^'<>]*'|[^\s>]*+))?)*+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)({ATTRIBUTES})(?:>|\Z)", re.DOTALL)
_NAMED = re.compile(r"""(?<![^\s/"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_HREF = re.compile(r"(?<![^\s/\"'])href\s*=", re.IGNORECASE)
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass
class Block:
    """A block's pieces and place."""

    tag: str
    boilerplate: bool
    content: bool
    pieces: list[str] = field(default_factory=list)
    link_words: int = 0
    words: int = 0
    text: str = ""


def _names(attributes: str) -> list[list[str]]:
    """The words of each class, id and role, without names that say what an element has."""
    found = []
    for m in _NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = _PARTS.findall(_CAMEL.sub(r"\1 \2", name).lower())
            if parts and parts[0] not in HAVING_WORDS:
                found.append(parts)
    return found


def _marks(tag: str, attributes: str, boilerplate: bool, content: bool) -> tuple[bool, bool]:
    """Whether text in an element stands in boilerplate and in an article, from the same of its parent."""
    names = _names(attributes) if attributes else []
    if tag in ("html", "body"):
        return boilerplate, content
    if tag in CONTENT_TAGS:  # a comment may be an article, so its whole names count
        return boilerplate or any(len(n) == 1 and n[0] in BOILERPLATE_WORDS for n in names), True
    words = {w for n in names for w in n}
    named = words & BOILERPLATE_WORDS - ({"header"} if content else set())
    inside = tag in BOILERPLATE_TAGS and not (tag == "header" and content)
    return boilerplate or inside or bool(named), content or bool(words & CONTENT_WORDS)


class _Stack:
    """Open elements: (tag, boilerplate, content, whether the element's own tag makes it boilerplate)."""

    def __init__(self):
        self.open: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
        self.count: Counter[str] = Counter()

    def cut(self, at: int) -> None:
        self.count.subtract(t for t, *_ in self.open[at:])
        del self.open[at:]

    def push(self, tag: str, attributes: str) -> None:
        if tag in BLOCK_TAGS:
            ends = ("p", *SIBLINGS.get(tag, ()))
            while self.count.total() and any(self.count[t] for t in ends):
                at = len(self.open) - 1
                while at and self.open[at][0] not in BLOCK_TAGS:
                    at -= 1
                if self.open[at][0] not in ends:
                    break
                self.cut(at)
        _, boilerplate, content, by_tag = self.open[-1]
        if tag in CONTENT_TAGS and by_tag:  # whole pages stand in forms, and unclosed menus go on to the end
            boilerplate = False
        inner, inside = _marks(tag, attributes, boilerplate, content)
        self.open.append((tag, inner, inside, inner and (by_tag if boilerplate else tag in BOILERPLATE_TAGS and not _marks("div", attributes, False, content)[0])))
        self.count[tag] += 1

    def pop(self, tag: str) -> None:
        if self.count[tag] <= 0:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self.cut(i)
                return
            if tag not in BLOCK_TAGS and self.open[i][0] in BLOCK_TAGS:
                return


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with references decoded and white space collapsed."""
    out: list[Block] = []
    stack = _Stack()
    current: Block | None = None
    linked, to_block_end = False, False
    missing: set[str] = set()
    at = 0

    def add(text: str) -> None:
        nonlocal current
        if not text:
            return
        if current is None:
            _, boilerplate, content, _ = stack.open[-1]
            holder = next((t for t, *_ in reversed(stack.open) if t in BLOCK_TAGS), "")
            current = Block(holder, boilerplate, content)
        current.pieces.append(text)
        if linked:
            current.link_words += len(entities.unescape(text).split())

    def close() -> None:
        nonlocal current, linked
        if current is not None:
            words = entities.unescape("".join(current.pieces)).split()
            if words:
                current.text, current.words = " ".join(words), len(words)
                out.append(current)
        current, linked = None, linked and not to_block_end

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            if m[1] is not None:
                add(m[1])
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag in SKIPPED_TAGS:
            if not closing and not m[4].rstrip().endswith("/"):
                at = _after(page, at, tag, missing)
            continue
        if tag == "br":
            add(" ")
        elif tag in BLOCK_TAGS:
            close()
        if tag == "a":
            linked = not closing and bool(_HREF.search(m[4]))
            if linked:
                nearest = _ANCHOR.search(page, at)
                to_block_end = nearest is None or not nearest[1]
        if tag in VOID_TAGS:
            continue
        if closing:
            stack.pop(tag)
        else:
            stack.push(tag, m[4])
    close()
    return out


_ends: dict[str, re.Pattern] = {}


def _after(page: str, at: int, tag: str, missing: set[str]) -> int:
    """Where the page goes on after an element whose inside is skipped. Without an end, code runs to the end of the page and other elements are ignored."""
    if tag not in _ends:
        _ends[tag] = re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.IGNORECASE)
    m = None if tag in missing else _ends[tag].search(page, at)
    while m and not m[1] and tag in CODE_TAGS:
        m = _ends[tag].search(page, m.end())
    if m is None:
        missing.add(tag)
        return len(page) if tag in CODE_TAGS else at
    return m.end() if m[1] else at  # the next one begins before this one ends: it has no end


def features(found: list[Block]) -> np.ndarray:
    """A row for each block: words and link density of the block before, the block, the one after; where it stands."""
    n = len(found)
    words = np.array([0, *(b.words for b in found), 0], dtype=float)
    density = np.array([0, *(b.link_words / max(1, b.words) for b in found), 0], dtype=float)
    rows = [words[:-2], words[1:-1], words[2:], density[:-2], density[1:-1], density[2:]]
    rows += [np.array([float(b.boilerplate) for b in found]), np.array([float(b.content) for b in found]), np.array([float(b.tag in HEADINGS) for b in found])]
    return np.array(rows).T if n else np.empty((0, 9))


# The labelled table. + stands for an article block, - for the rest; blocks are in page order.
LABELLED_PAGES = (
    ("-++-", "<nav><a href=x>home</a> <a href=x>about</a></nav><article><h1>A title of the day</h1><p>Some words of the story that go on for a while and then end.</p></article><footer>All rights reserved by the owner</footer>"),
    ("--+++-", "<ul class=menu><li><a href=x>one</a><li><a href=x>two</a></ul><main><h1>Title</h1><p>Short.</p><p>The paragraph with more words than the one before it has, by far.</p></main><div class=sidebar>read this too and more of it here</div>"),
    ("-+-+", "<div class=ad>Buy the best things here today for less</div><article><p>First part of the text here.</p><div class=ad>Buy now</div><p>Second.</p></article>"),
    ("++--", "<article><h2>Head</h2><p>Body of text in a few words only.</p></article><section class=comments><p>I liked reading this very much, thanks to the writer for all the words in it.</p><p>Me too!</p></section>"),
    ("+-", "<div><p>A page without any markers, whose only paragraph is long enough to be taken for the article that it is, with many words in a row.</p></div><p><a href=x>next</a></p>"),
    ("-+", "<p><a href=x>back to the list</a></p><p>Here the long running text of the page begins and it continues for quite some time so that nobody can miss it at all.</p>"),
    ("----", "<div><a href=x>a</a></div><div><a href=x>b c</a></div><div>Contact</div><div><a href=x>d</a></div>"),
    ("+++", "<main><p>One.</p><p>Two words.</p><p>Three words here.</p></main>"),
    ("++", "<article><p>See <a href=x>the other long page</a></p><p><a href=x>link</a></p></article>"),
    ("-+-", "<div class=cookie-notice><p>We use cookies so that the site works and to count how many people read which of the pages.</p></div><div class=post><p>The entry for the day is this text.</p></div><form><label>Your mail address please</label></form>"),
    ("-", "<div class=newsletter>Subscribe to our letter and get all of the news by mail every day of the week without paying</div>"),
    ("-+", "<p>Menu</p><p>Running text without links or any marker that is long: it has far more than a dozen words, as articles do have in general.</p>"),
    ("+-+", "<article><p>Part one of it.</p><aside>See also the other parts</aside><p>Part two.</p></article>"),
    ("--", "<p>Login</p><p>Imprint</p>"),
)


# More pages. A sign as above, the words of a block, after / how many of them are linked; h: a heading, a: in an
# article, b: in an element that names boilerplate, ab: in both. The second half has no marks.
COUNTED_PAGES = (
    "-1/1b -1/1b -2/2b -1/1b -9b +9ha +60a +14a +48a +5a +33/2a -8b",
    "-4b -5b +7ha +3a +88a +12a +41/6a -6/6b -6/6b -20b",
    "-2/2b -1/1b -30b +11ha +2a +6a +4a +9a -12b -1/1b",
    "-1 -3/3 +8ha +22a -15ab +37a -4/4ab +18a +1a -7/2",
    "-6/6b -6/6b -45b +5ha +120a +4/4a +2/2a +95/30a -3b -60b -25b",
    "-1b -1b -1b +10ha +7a +7a +150a +28/3a -9/1b",
    "-2/1 -14b +6ha +1a +1a +19a +5/5a +64a -35b -28b -41b -6b",
    "-3/3b -8b +200a +3a +9/4a +75a -11b",
    "-24b -18b +4ha +16a +11a -22ab -7ab +13a -2/2 -2/2",
    "-1/1b +12ha +52a +8/8a +3/1a +2a -5/5b -5/5b -70b -13",
    "-40b -16/2b +10a +5a +31a +6a -9 -3b",
    "-5/5 -6/6 +9ha +17a +90a -33b -1ab +26a -50b -12/1b",
    "-2b -2b -2b -19b +3ha +45a +4a +66/2a +8a +35a -10b -4/4b",
    "-7b -12b -55b -6b -2/2b",
    "+6ha +84a +2a +15a -80b -44b -38/1b -61b",
    "-8/8b -10 +7ha +1a +5a +2a +3a -21b -7/7b",
    "-9/9 -9b +30a +9/9a +27a -1/1b -14/3b",
    "-1/1b -1/1b -1/1b -4/2b +13ha +70a +11/11a +58a +6ha +23a +49a -17b",
    "-1/1 -1/1 -2/2 -1/1 +7h +52 +61/2 +9 +48 +33 -8/8 -6/6 -9/1",
    "-2 -1 -1 +9h +80 +12 +74/3 +5 +66 -7 -2/2",
    "-4/4 -12/11 -9/9 +6 +41 +38 +22 +57/4 +3 +47 -5/5 -6/6 -4/4",
    "-3 -5/5 +8h +25 +31 +18 +4 +29 +44 -11/9 -2/2 -1/1",
    "-2/2 -2/2 -2/2 -2/2 +35 +40 +37 -3/3 -3/3",
    "-9 +6h +90 +85/6 +15 +70 -8 -1/1 -1/1",
    "-1/1 -1/1 +11h +14 +63 +58 +7 +71/1 +13/1 +49 -10/2",
    "-14/14 -12/12 -13/13 -15/15 -11/11 -12/12",
    "-1 -1 -2 -1 -3 -2 -1",
    "-6/6 +45 +6 +8 +39 +2 +51 -4 -3/3 -9/9",
    "-3/1 -2 +120 +97/10 +88 -5/4 -5/4 -5/4",
    "+5h +30 +10 +33/3 +28 -7/6 -6/6",
    "-2/2 +1h +36 +20 +19 +24 +17 -2/2 -7",
    "-1/1 -1/1 +2h +44 +38 +21 -3/3",
    "+1h +58 +20 +33 -5/5",
    "+44 +23",
    "+61 +18 +35 -2/2",
    "+38 +21 -4",
    "+29/1 +14 +40",
    "-5 -4/4 +7h +42 +11/3 +36 +54/5 +8 +60 -6/6 -7/7 -20/18 -3",
    "-25/20 -18/15 -30/27 -22/19 -16/14",
    "+64 +59 +72",
    "-8/3 +27 +23 +26/2 -9/5 -1/1",
    "-1/1 -3/3 -6 +10h +55 +47 +62 +6h +39 +5 +43 +7h +51 -12 -1/1 -2/2",
)


@dataclass(frozen=True)
class Node:
    """A split (value at most `cut` goes to `low`) or, without a feature, a leaf with the share of article blocks."""

    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node:
    """A decision tree by Gini impurity; ties go to the earlier feature and the lower cut."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return Node(share)
    best = (share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = y[x[:, f] <= cut]
            high = y[x[:, f] > cut]
            cost = len(low) * low.mean() * (1 - low.mean()) + len(high) * high.mean() * (1 - high.mean())
            if cost < best[0] - 1e-9:
                best = (cost, f, float(cut))
    if best[1] < 0:
        return Node(share)
    side = x[:, best[1]] <= best[2]
    return Node(share, best[1], best[2], grow(x[side], y[side], depth - 1), grow(x[~side], y[~side], depth - 1))


def counted(page: str) -> tuple[str, list[Block]]:
    """The signs and blocks of a page in the short form of COUNTED_PAGES."""
    found = [re.fullmatch(r"([+-])([0-9]+)(?:/([0-9]+))?(h?)(a?)(b?)", x) for x in page.split()]
    return "".join(m[1] for m in found), [Block("h2" if m[4] else "p", bool(m[6]), bool(m[5]), link_words=int(m[3] or 0), words=int(m[2])) for m in found]


def labelled_pages() -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and signs (1: article) of the blocks of each labelled page."""
    found = [(marks, blocks(page)) for marks, page in LABELLED_PAGES] + [counted(page) for page in COUNTED_PAGES]
    for marks, rows in found:
        if len(rows) != len(marks):
            raise ValueError(f"{len(rows)} blocks but labels {marks}")
    return [(features(rows), np.array([m == "+" for m in marks], dtype=float)) for marks, rows in found]


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    pages = labelled_pages()
    return np.concatenate([x for x, _ in pages]), np.concatenate([y for _, y in pages])


def left_out_accuracy(columns: list[int] | None = None) -> float:
    """The share of labelled blocks that a tree grown without their page judges rightly; columns: the features to use."""
    pages = labelled_pages()
    use = slice(None) if columns is None else columns
    right = 0
    for i, (x, y) in enumerate(pages):
        rest = pages[:i] + pages[i + 1 :]
        tree = grow(np.concatenate([a for a, _ in rest])[:, use], np.concatenate([b for _, b in rest]))
        right += sum(a == (b == 1) for a, b in zip(decide(tree, x[:, use]), y, strict=True))
    return right / sum(len(y) for _, y in pages)


@lru_cache
def default_tree() -> Node:
    return grow(*labelled_table())


def decide(tree: Node, rows: np.ndarray) -> list[bool]:
    out = []
    for row in rows:
        node = tree
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        out.append(node.share >= 0.5)
    return out


def main_text(page: str | None, tree: Node | None = None) -> str:
    """The article blocks of a page, joined by newlines; empty for null, empty and article-less pages."""
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, ok in zip(found, decide(tree or default_tree(), features(found)), strict=True) if ok)


def extract(pages: DataFrame, *, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars", tree: Node | None = None) -> DataFrame:
    """pages plus the main text and its length in code points.

    Each row stands alone: repeated rows give repeated results, other columns do not matter (columns
    named like the new ones are replaced). Null and empty pages have no text, an empty table no rows.
    Comments, scripts and styles without an end run to the end of the page; other unclosed elements don't.
    """

    def run(column: pa.Array) -> list[pa.Array]:
        texts = [main_text(p, tree) for p in column.to_pylist()]
        return [pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())]

    return with_added(pages, [T.StructField(text_col, T.StringType()), T.StructField(chars_col, T.LongType())], html_col, run)


def extraction_report(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    got = extract(pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html")))
    return got.select("page_id", "url", "text", "n_chars")
