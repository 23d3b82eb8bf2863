"""HTML extraction: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks. Each has its word count and link
density, those of its neighbours, marks of the regions and class names around it,
and whether the page has an article region at all; a tree trained on a small
labelled table of blocks says which belong to the article. Pages without such a
region are judged by words and links of a block and its neighbours. An advert
inside a line is a block of its own, beside the one that it interrupts.

Defined cases: null or empty html gives empty text; an unclosed comment, script
or tag runs to the end of the page; a page with only boilerplate gives empty
text; pages of any length are read whole, in one pass; repeated rows are treated
row by row; an empty table gives no rows; further columns, whatever their names,
are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, slices
from .trees import Tree

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements by what they do to the flow.
RAW = {"script", "style", "template", "noscript", "svg", "iframe", "object", "textarea", "select", "title", "math", "canvas", "video", "audio"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
REGIONS = {"nav": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "fieldset": "form", "button": "form", "dialog": "notice", "menu": "menu", "head": "head", "article": "article", "main": "article"}
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "figure", "blockquote", "body", "details"}
HINTS = set(
    "ad ads adv advert advertisement advertising adbox adsense banner promo promotion sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations trending popular widget pagination pager tags login search form copyright legal disclaimer toolbar skip".split()
)
ADVERTS = set("ad ads adv advert advertisement advertising adbox adsense promo sponsor sponsored".split())
COMMENTS = set("comment comments commentlist reply replies respond disqus discussion feedback reader".split())
GOOD = set("article content main post story entry body text".split())
#: Marks of boxes around an article.
OUTER = {"hint": "hint around", "comments": "comments around"}
#: Words of a block in which a copyright sign tells of a footer.
SHORT = 20
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"}
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


@dataclass
class Block:
    tag: str
    regions: frozenset[str]
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    text: str = ""
    words: int = 0
    density: float = 0.0


def _names(attributes: str) -> set[str]:
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        names.update(re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()))
    return names


def _marks(attributes: str) -> set[str]:
    names, out = _names(attributes), set()
    if names & COMMENTS:
        out.add("comments")
    if names & HINTS:
        out.add("hint")
    if names & GOOD and not out:
        out.add("good")
    return out


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, with white space folded and references decoded."""
    found: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = [("", frozenset())]
    opened: Counter = Counter()  # names on the stack, so that an end tag without a start costs nothing
    current = Block("", frozenset())
    beside: list[Block] = []  # adverts in the current block's lines
    within: list[str] = []  # the inline elements from an advert's start on
    in_link = 0
    at = 0
    tag = ""

    def done(block: Block) -> None:
        block.text = " ".join(entities.unescape("".join(block.parts)).split())
        block.words = len(block.text.split())
        if block.words:
            block.density = min(1.0, len(" ".join(block.linked).split()) / block.words)
            found.append(block)

    def close() -> None:
        nonlocal current
        for block in (current, *beside):
            if block.parts:
                done(block)
        beside.clear()
        within.clear()
        current = Block(tag, stack[-1][1])

    def add(text: str) -> None:
        if text:
            to = beside[-1] if within else current
            to.parts.append(text)
            if in_link:
                to.linked.append(entities.unescape(text))

    while True:
        m = _PART.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in INLINE:
            if m[1]:
                if name in within:
                    while within.pop() != name:
                        pass
            elif name not in _VOID and not m[3].rstrip().endswith("/") and (within or (m[3] and _names(m[3]) & ADVERTS)):
                if not within:
                    beside.append(Block(name, stack[-1][1] | {"hint"}))
                within.append(name)
            if name == "a":
                in_link = 0 if m[1] else 1
            continue
        if m[1]:
            if opened[name]:
                close()
                while True:
                    last, _ = stack.pop()
                    opened[last] -= 1
                    if last == name:
                        break
            tag = ""
            close()
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/"):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in REGIONS or name in CONTAINERS:
            regions, own = set(stack[-1][1]), _marks(m[3]) if name != "body" else set()  # a body's classes tell of the whole page
            if REGIONS.get(name) == "article":
                own.discard("hint")  # an article's classes tell what it is about
                if "article" not in regions:  # what is said of boxes around it is weighed at the end
                    regions = {OUTER.get(r, r) for r in regions}
            regions |= own
            if name in REGIONS:
                regions.add(REGIONS[name])
            stack.append((name, frozenset(regions)))
            opened[name] += 1
            tag = name
            close()
        else:
            tag = name
            in_link = 0
            extra = _marks(m[3]) if m[3] else set()
            close()
            if extra:
                current.regions = frozenset(current.regions | extra)
            if name in _VOID:
                current.tag = current.tag or name
    tag = ""
    close()
    # Marks of boxes around an article tell it from others on the page; where all have them, they tell nothing.
    inner = [b for b in found if "article" in b.regions]
    names = {OUTER[r]: r for r in OUTER if any(OUTER[r] not in b.regions for b in inner)}
    for b in inner:
        b.regions = frozenset(names.get(r, r) for r in b.regions)
    return found


def features(found: list[Block]) -> np.ndarray:
    """One row for each block: own, previous and next words and link density, then marks."""
    n = len(found)
    x = np.zeros((n + 2, 13))
    some = any("article" in b.regions for b in found)
    for i, b in enumerate(found, 1):
        r = b.regions
        x[i] = [
            min(b.words, 200), b.density, 0, 0, 0, 0, "article" in r, bool(r & {"menu", "head", "foot", "side", "form", "notice"}), "hint" in r, "comments" in r,
            b.tag in {"h1", "h2", "h3", "h4", "h5", "h6"}, b.words <= SHORT and "\N{COPYRIGHT SIGN}" in b.text or "good" in r and 0.5, some,
        ]
    x[1:-1, 2:4], x[1:-1, 4:6] = x[:-2, :2], x[2:, :2]
    return x[1:-1]


#: The labelled table: small pages, and for each block 1 if it is of the article.
LABELLED: list[tuple[str, str]] = [
    ("<nav><ul><li><a href=1>Home</a><li><a href=2>World news</a></ul></nav><div class=ad>Buy now and save a lot of money today.</div><article><h1>A title here</h1><p>First words of the text go on for a while, as they do.<p>Short.<p>Then more text with <a href=3>one link</a> in it.</article><footer>&copy; Example. All rights.</footer>", "00011110"),
    ("<header><h1>The site</h1><p>Your daily paper for the whole town</p></header><main><h1>Title</h1><p>Body text of some length stands here for the reader to read.</p><ul><li>one item</li><li>another item</li></ul></main><aside><h2>Most read</h2><ul><li><a>One story</a><li><a>Two story</a></ul></aside><footer>Contact us by mail at any time of the day.</footer>", "0011110000"),
    ("<div id=header>Welcome to the site</div><div id=menu><a>Start</a> | <a>About</a></div><div id=content><h2>Title words</h2><p>Long body text that runs over a line or two and tells of things.</p><p>Yes.</p></div><div class=sidebar><p>About the author of this and other texts, who lives in a town.</p></div><div id=footer>Imprint and terms &copy; 2020</div>", "0011100"),
    ("<article><h1>Head</h1><p>Some text here in the body of the piece.</p><div class='ad'>Cheap shoes for every foot, order them today.</div><p>More text after the advert that goes on.</p><section class=comments><h3>Comments</h3><p>I liked this text very much, thank you for it.</p><p>Me too.</p></section></article>", "1101000"),
    ("<div class='cookie notice'><p>We use cookies to make this site better for you. Read more in our terms.</p><button>Accept</button></div><article><p>The text itself begins here and it has words.</p><table><tr><td>cell one</td><td>cell two</td></tr></table><blockquote>A quoted line of text.</blockquote></article><form><label>Your mail</label><input><button>Send</button></form>", "00111100"),
    ("<p>A bare page with no marks at all, only its text in a paragraph.</p><p>And a second paragraph that follows it with more text.</p><p><a>Home</a> <a>Back</a></p>", "110"),
    ("<body><div><a>One</a> <a>Two</a> <a>Three</a></div><div><p>Plain text in a plain box that has enough words to count as text.</p><p>It has a second paragraph with as many words or a few more.</p></div><div>&copy; Someone 2021</div></body>", "0110"),
    ("<article><h2>Part one</h2><p>Words.</p><h2>Part two</h2><p>See <a>this other long text about it</a>.</p><footer>Filed under news by the editor</footer></article><div class=related><h3>Related</h3><ul><li><a>Other</a><li>And one more</ul></div>", "11110000"),
    ("<article><header><p>By the editor, on a day in May</p></header><p>The text starts in the article and goes on.</p><aside>Did you know that the sea is deep and salt?</aside><p>And ends.</p><nav><a>Next</a></nav><form>Write to us about this text here</form></article><div class=comments><p>First reader says that it is good and right.</p></div>", "0101000"),
    ("<div class=post><h1>Post</h1><p>My text of today is short but mine, as it was before.</p></div><div class=comment><p>Nice text, I read it twice and sent it to a friend.</p></div><div class=newsletter><p>Get our letter every week for free.</p></div>", "1100"),
    ("<dialog><p>Please log in to go on with reading this page here.</p></dialog><article><p>Here.</p><p>Text with many words that goes on over the line, and more of them, until it ends.</p><div class=share><a>Share</a> <a>Like</a></div><div class='notice'>This notice is not of the text.</div></article>", "01100"),
    ("<article><p>Two words</p></article>", "1"),
    ("<article>One</article>", "1"),
    ("<nav><a>Start</a></nav><article><p>Yes.</p></article><footer>Foot</footer>", "010"),
    ("<nav><ul><li><a>a</a><li><a>b</a></ul></nav><div class=ad>Buy this.</div><article><h1>Short</h1><p>Sh is.</p></article><footer>&copy; x</footer>", "000110"),
    ("<div>Menu <a>one</a></div><article><p>Here it ends.</p></article>", "01"),
    ("<article><p><a>A whole paragraph that is one link in the text</a></p><p>Plain again, with words.</p><ul><li><a>linked item in text</a></li></ul></article><ul><li><a>x</a></li><li><a>y</a></li></ul>", "11100"),
]


def _sized() -> Iterator[tuple[str, str]]:
    """The same kinds of blocks at many lengths, so that a region counts for more than a length that it happens to have."""
    text = lambda n: " ".join(["word"] * n)
    for n in (1, 3, 8, 12, 20, 60, 150):
        for m in (1, 4, 10, 15, 40, 120):
            yield f"<nav><a>{text(2)}</a></nav><div class=ad>{text(n)}</div><article><h1>{text(m)}</h1><p>{text(m)}</p><p>{text(n)}</p></article><footer>{text(m)} &copy;</footer>", "001110"
            yield f"<div class=sidebar>{text(m)}</div><div><p>{text(n)}</p><p>{text(m)}</p></div><div class=ad>{text(n)}</div><div class=menu>{text(m)}</div>", "01100"
            yield f"<header>{text(n)}</header><main><p>{text(m)}</p></main><aside>{text(m)}</aside>", "010"
            yield f"<article><p>{text(n)}</p><div class=comments>{text(m)}</div><div class=promo>{text(n)}</div><p>{text(m)}</p></article>", "1001"


def _bare() -> Iterator[tuple[str, str]]:
    """Pages whose elements have no names: menus and lists are links, the article is lines of many words and the short ones between them."""
    text = lambda n: " ".join(["word"] * n)
    links = lambda n, k: "".join(f"<tr><td><a>{text(k)}</a></td></tr>" for _ in range(n))
    for n in (14, 20, 35, 60, 120, 200):
        for m in (2, 4, 6, 9):
            yield f"<table>{links(3, m)}<tr><td>{text(n)}</td></tr></table>", "0001"
            yield f"<table>{links(2, m)}</table><h1>{text(m)}</h1><div>{text(n)}</div><div>{text(m)}</div><div>{text(n + 7)}</div><div>{text(n)}</div>{links(2, m)}", "00111110" + "0"
            yield f"<div><a>{text(m)}</a> {text(1)}</div><p>{text(n)}</p><p>{text(n)} <a>{text(2)}</a></p><h2>{text(m)}</h2><p>{text(n)}</p><div><a>{text(m)}</a></div><div>{text(m)} &copy;</div>", "0111100"
            yield f"<div><p>{text(n)}</p><p>{text(m)}</p><p>{text(n)}</p></div><table>{links(4, m)}</table>", "1110000"


def labelled() -> tuple[np.ndarray, np.ndarray]:
    rows, marks = [], []
    for page, labels in [*LABELLED, *_sized(), *_bare()]:
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"{len(found)} blocks, {len(labels)} labels: {[b.text for b in found]}")
        rows.append(features(found))
        marks += map(int, labels)
    return np.concatenate(rows), np.array(marks)


@lru_cache(1)
def model() -> Tree:
    return Tree(*labelled(), depth=10)


def extract(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = model().predict(features(found)) >= 0.5
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                texts = [extract(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    return mapped(pages.selectExpr("cast(page_id as bigint) page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark, sf_dir):
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
