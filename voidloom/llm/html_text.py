"""Main text of web pages by two-pass block rules.

First pass: each block is labelled by its stop-word density, length and link density; what stands in menus, adverts,
forms, comments, hidden or other boilerplate elements is bad. Long blocks with many stop words are good, lists of links and long
blocks without stop words are bad, and the rest is open: short, or near to good. Second pass: open blocks take the label of the
nearest decided block. An ``article`` or ``main`` element is a region of its own: labels do not cross its bounds, and inside it
only boilerplate elements and list items of links are bad, so open blocks there are good like the text around them.

Null html gives ``''``; whole pages are read, nothing is capped. Repeated rows are handled alike and all stay, an empty table gives an
empty table, and kept columns that are called like a result are replaced by it.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stop words of the four languages of the corpus.
STOP_WORDS = frozenset(
    """
    the of and to in a is that for it was on with as by be at are this from or an which not have has he they his
    le la les de des du un une et en que qui dans pour pas sur est au par avec ce il se plus ne sont
    der die das den dem des ein eine und zu mit auf ist im von nicht sich für auch als an es bei aus werden
    el los las del una y que en por con para su no es lo se al más como pero sus
    """.split()
)
#: Elements whose content is never text (without an end: the rest of the page; nothing; up to the next block),
#: elements that hold blocks, and elements that end a block.
RAW = "script|style|textarea|title"
CLOSED = "noscript|template|iframe"
SKIPPED = frozenset("svg math select object canvas button audio video".split())
CONTAINERS = frozenset("div section article main nav aside header footer form ul ol dl table figure details dialog fieldset menu center address".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr blockquote pre hr body html head caption figcaption summary legend tbody thead".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_TAGS = frozenset("nav aside header footer form dialog fieldset menu".split())
#: Words in class, id or role that mark a container as not part of the article.
BAD_WORDS = frozenset(
    """
    ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
    notices alert popup modal overlay newsletter subscribe subscription signup login sidebar complementary nav navbar
    navigation menu menubar breadcrumb breadcrumbs footer header masthead contentinfo topbar toolbar share sharing social
    related recommended trending comment comments commentlist reply replies respond disqus widget widgets pager
    pagination search copyright disclaimer
    """.split()
)
#: Of these, the words that an article's own parts may be called by.
TITLE_WORDS = frozenset("header masthead copyright disclaimer search banner".split())
VALUE = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
TAGS = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b{VALUE}>.*?(?:</\1\s*>|\Z)|<({CLOSED})\b{VALUE}>.*?</\2\s*>|<[!?][^>]*>"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({VALUE})>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S | re.I,
)
MARKS = re.compile(r"([a-zA-Z_:@][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPLIT = re.compile(r"[^a-z]+")
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Limits:
    """Thresholds of the block rules, in characters and shares."""

    short: int = 70
    long: int = 200
    link_density: float = 0.2
    list_density: float = 0.5
    stop_low: float = 0.1
    stop_high: float = 0.2


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    bad: bool
    article: int  # number of the article or main element around it, 0 outside
    label: str = ""


def marks_of(attributes: str) -> Iterator[tuple[str, str]]:
    """Attribute names and values in lower case."""
    for name, a, b, c in MARKS.findall(attributes):
        yield name.lower(), (a or b or c).lower()


def is_hidden(attributes: str) -> bool:
    return any(name == "hidden" or name == "style" and "display:none" in value.replace(" ", "") for name, value in marks_of(attributes))


def is_bad(tag: str, attributes: str, in_article: bool = False) -> bool:
    """Whether an element is boilerplate by its tag, its class, id or role, or as it is hidden."""
    if tag in BAD_TAGS:
        return True
    if not attributes:
        return False
    if is_hidden(attributes):
        return True
    bad = BAD_WORDS - TITLE_WORDS if in_article else BAD_WORDS
    if tag in ("article", "main"):
        bad = {"comment", "comments", "related"}
    return any(name in ("class", "id", "role") and not bad.isdisjoint(SPLIT.split(value)) for name, value in marks_of(attributes))


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, white space folded and character references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []
    parts: list[str] = []
    linked, link, breaks, articles, tag_now, bad_now = 0, 0, 0, 0, "", False
    skipped, depth = "", 0  # an element without text, and how often it is open

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            _, bad, article = stack[-1] if stack else ("", False, 0)
            out.append(Block(text, min(linked, len(text)), tag_now, bad or bad_now, article))
        parts.clear()
        linked = 0

    at = 0
    for m in TAGS.finditer(page):
        if m.start() > at and not skipped:
            piece = page[at : m.start()]
            parts.append(piece)
            if not piece.isspace():
                breaks = 0
                linked += len(piece) if link else 0
        at = m.end()
        close, tag, attributes = (m[3], m[4], m[5]) if m[4] else (m[6], m[7], m[8])
        if not tag:
            continue
        tag = tag.lower()
        if skipped:
            if tag == skipped:
                depth += -1 if close else not attributes.rstrip().endswith("/")
                skipped = skipped if depth else ""
                continue
            if tag not in BLOCKS:
                continue
            skipped, depth = "", 0  # a block ends an element that was left open
        if tag in SKIPPED or tag not in BLOCKS and not close and tag not in VOID and attributes and is_hidden(attributes):
            if not close and not attributes.rstrip().endswith("/"):
                skipped, depth = tag, 1
        elif tag == "a":
            link = 0 if close else 1
        elif tag == "br":
            parts.append(" ")
            breaks += 1
            if breaks == 2:
                flush()
        elif tag in ("td", "th"):
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            link = breaks = 0
            tag_now, bad_now = "" if close else tag, False
            if tag in CONTAINERS and not close:
                if tag in ("article", "main"):  # an unclosed menu or header does not swallow the article
                    while stack and stack[-1][0] in ("nav", "header", "ul", "ol"):
                        stack.pop()
                    articles += 1
                _, bad, article = stack[-1] if stack else ("", False, 0)
                inside = articles if tag in ("article", "main") else article
                heading_box = tag == "header" and article and not bad  # a header inside the article holds its title
                stack.append((tag, bad or (is_bad(tag, attributes, article > 0) and not heading_box), inside))
            elif tag in CONTAINERS and any(x[0] == tag for x in stack):
                while stack.pop()[0] != tag:
                    pass
            elif not close and attributes and tag not in ("html", "body"):
                bad_now = is_bad(tag, attributes, bool(stack and stack[-1][2]))
    if at < len(page) and not skipped:
        parts.append(page[at:])
    flush()
    return out


def first_pass(block: Block, limits: Limits) -> str:
    """good, bad, or still open: near (to good) and short."""
    n = len(block.text)
    density = block.linked / n
    if block.bad or "©" in block.text[:2]:
        return "bad"
    if block.article:
        if block.tag == "li" and density > limits.list_density:
            return "bad"
    elif density > limits.link_density:
        return "bad"
    if block.tag in HEADINGS or n < limits.short:
        return "short"
    words = LETTERS.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= limits.stop_high and n > limits.long:
        return "good"
    return "near" if stops >= limits.stop_low or block.article else "bad"


def second_pass(found: list[Block]) -> None:
    """Open blocks take the label of the nearest decided block of their region: an article, or all that is outside.

    In an article boilerplate and lists of links tell nothing about the text around them, and without a decided block
    the element itself decides.
    """
    regions: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        regions.setdefault(b.article, []).append(i)
    for article, members in regions.items():
        decided = [i for i in members if found[i].label == "good" or found[i].label == "bad" and not article]
        labels = {}
        for i in members:
            b = found[i]
            if b.label in ("good", "bad"):
                continue
            k = bisect_left(decided, i)
            near = decided[max(0, k - 1) : k + 1]
            if b.tag in HEADINGS and k < len(decided):
                near = [decided[k]]
            like = "good" if article or b.label == "near" else "bad"  # of two equally near ones
            near.sort(key=lambda j: (abs(j - i), found[j].label != like))
            labels[i] = found[near[0]].label if near else "good" if article or len(regions) == 1 else "bad"
        for i, label in labels.items():
            found[i].label = label


def main_text(page: str | None, limits: Limits = Limits()) -> str:
    """The article's blocks joined by newlines; ``''`` if there are none."""
    found = blocks(page or "")
    for b in found:
        b.label = first_pass(b, limits)
    second_pass(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract_text(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), limits: Limits = Limits()) -> DataFrame:
    """The kept columns, ``text`` and ``n_chars`` (code points); a pure map, without a shuffle."""
    keep = tuple(c for c in keep if c.lower() not in ("text", "n_chars"))
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("__html"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), limits) for x in batch.column(len(keep))]
            cols = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "text", "n_chars"])

    return source.mapInArrow(run, f"{kept}text string, n_chars long")
