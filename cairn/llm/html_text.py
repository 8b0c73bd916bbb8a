"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides each
block from its place, link density, stop-word density and length; the second
gives blocks too short to decide the label of the nearest decided neighbours,
those of the same container before others.

Names only hint at furniture: an element switched off by its class, id or role
is read after all where it holds an article without such a name that outweighs
what is left; never for want of other text. Furniture by its tag that is never
closed ends where an article or main element begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his in is it not of on or she that the their they this to was were which with you
    als am auch auf aus bei das dass dem den der des die ein eine einer für hat ich im in ist mit nach nicht noch nur oder sich sie sind und von war wie zu zum
    au aux avec ce cette dans de des du elle en est et il la le les leur mais ne ou par pas plus pour qu que qui sa se ses son sont sur un une
    al como con de del el ella en es esta este fue ha la las lo los más no o para pero por que se si sin su sus un una y""".split()
)
# What the HTML standard calls these elements.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = "script|style|noscript|template|iframe|title|textarea|select|button|svg|math|object|canvas|audio|video"
OFF_TAGS = frozenset("nav footer aside form dialog menu head header".split())
_OFF_TAG = re.compile(rf"<(/?)({'|'.join(sorted(OFF_TAGS, key=len, reverse=True))})(?![\w:-])", re.I)
# What class, id and role call furniture: a whole token, or a part of one between hyphens or underscores.
OFF_NAMES = re.compile(
    r"(?:^|[_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|newsletter|subscri\w*|"
    r"sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|replies|disqus|share|sharing|social|"
    r"related|recommend\w*|popup|modal|overlay|pagination|complementary|contentinfo)(?:$|[_-])"
)
# These are whole tokens or nothing, and switch off only what is not running text.
WEAK_NAMES = frozenset("alert login pager reply search side signup skip toolbar widget".split())
# Parts that make a name a state of the page ("with-sidebar", "sidebar-layout"), not what the element is.
STATE = re.compile(r"(?:^|[_-])(?:with|without|has|have|no|not|show|hide|is)[_-]|[_-](?:layout|theme|template|enabled)$|^(?:page|site|body)[_-].*[_-]fixed$")
MAIN_TAGS = frozenset(("article", "main"))
_ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW_TAGS})\b{_ATTRS}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)({_ATTRS})>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>", re.S | re.I
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"\w+")

SHORT = 70  #: characters under which a block is too short to decide alone
LONG = 200  #: and from which one with few stop words is decided against
STOPS_HIGH, STOPS_LOW = 0.2, 0.1
LINKS_MOST = 0.5
MAIN_LEAST = 0.2  #: share of a page's prose from which articles and main are all that counts


class Block:
    __slots__ = ("text", "linked", "off", "main", "home", "label", "names", "stops")

    def __init__(self, text: str, linked: int, off: bool, main: int, home: int, names: tuple[int, ...] = ()):
        self.text, self.linked, self.off, self.main, self.home, self.label, self.names = text, linked, off, main, home, None, names
        words = WORD.findall(text.lower())
        self.stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0

    def prose(self, any_language: bool) -> int:
        """Characters, if the block is sure to be running text."""
        n = len(self.text)
        sure = (n >= SHORT and self.stops >= STOPS_HIGH) or (any_language and n >= LONG)
        return n if sure and self.linked <= LINKS_MOST * n else 0


def blocks_of(page: str) -> tuple[list[Block], set[int]]:
    """The page's blocks in order, and the numbers of elements whose name is
    weak. `off`: inside an element that is furniture
    by its tag or hidden; `names`: numbers of the elements around it that are
    furniture by name only, outermost first, before 0 those outside its
    article or main; `main`: number of the article or main element around
    it, 0 outside; `home`: number of the innermost container."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int, tuple[int, ...]]] = []  # tag, off, main, home, names; of elements with an end tag of their own
    parts: list[str] = []
    off, main, home, opened, links, linked, at = False, 0, 0, 0, 0, 0, 0
    names: tuple[int, ...] = ()
    weak: set[int] = set()

    unclosed: dict[str, int] = {}
    for m in _OFF_TAG.finditer(page):
        unclosed[m[2].lower()] = unclosed.get(m[2].lower(), 0) + (-1 if m[1] else 1)

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(text, linked, off, main, home, names))
        linked = 0

    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[1] and m[1].lower() not in ("svg", "math", "button"):
                parts.append(" ")
            continue
        ends = bool(m[2] or m[5])
        if tag == "a":
            links = 0 if ends else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        attrs = m[4] or m[7] or ""
        named, hidden = _said(attrs) if attrs and not ends else ("", False)
        if tag not in BLOCK_TAGS:
            if (named or hidden) and tag not in VOID_TAGS and not attrs.endswith("/"):
                close()
                stack.append((tag, off, main, home, names))
                opened += 1
                off, names = off or hidden, (*names, opened) if named else names
                if named == "weak":
                    weak.add(opened)
            elif ends and any(x[0] == tag for x in stack):
                close()
                off, main, home, names = _leave(stack, tag, off, main, home, names)
            continue
        close()
        links = 0
        if ends:
            off, main, home, names = _leave(stack, tag, off, main, home, names)
            continue
        if tag in MAIN_TAGS:
            for left in [x[0] for x in stack if x[0] in OFF_TAGS and unclosed.get(x[0], 0) > 0]:
                unclosed[left] -= 1
                off, main, home, names = _leave(stack, left, off, main, home, names)
        if tag not in VOID_TAGS and tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "option", "html", "tbody", "thead", "tfoot"):
            stack.append((tag, off, main, home, names))
            opened += 1
            home = opened
            if named == "weak":
                weak.add(opened)
            if tag in MAIN_TAGS and not main:
                main, names = opened, (*names, 0) if names else names
            if hidden or (tag in OFF_TAGS and not (tag == "header" and main)):
                off = True
            if named and tag not in ("body", "main"):
                names = (*names, opened)
        elif (named or hidden) and tag in ("p", "li", "tr", "td"):
            # no end tag to rely on: off until this element's own end, if it has one
            stack.append((tag, off, main, home, names))
            opened += 1
            off, names = off or hidden, (*names, opened) if named else names
            if named == "weak":
                weak.add(opened)
    if at < len(page):
        parts.append(page[at:])
    close()
    return out, weak


def _said(attrs: str) -> tuple[str, bool]:
    """Whether an element's attributes name it furniture ("strong", "weak" or
    ""), and whether they hide it."""
    named, hidden = "", False
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            for token in value.split():
                if OFF_NAMES.search(token) and not STATE.search(token):
                    named = "strong"
                elif token in WEAK_NAMES:
                    named = named or "weak"
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
    return named, hidden


def _leave(stack: list, tag: str, off: bool, main: int, home: int, names: tuple[int, ...]) -> tuple[bool, int, int, tuple[int, ...]]:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == tag:
            _, off, main, home, names = stack[i]
            del stack[i:]
            break
    return off, main, home, names


def _read_after_all(blocks: list[Block], weak: set[int], any_language: bool) -> set[int]:
    """Numbers of the elements whose names are not held against them."""
    read = {0}
    for k in weak:
        own = [b for b in blocks if k in b.names]
        if 2 * sum(b.prose(any_language) for b in own) > sum(len(b.text) for b in own):
            read.add(k)
    seen = [b for b in blocks if not b.off]
    named = [b for b in seen if b.names]
    if not named:
        return read
    kept = sum(b.prose(any_language) for b in seen if read.issuperset(b.names))
    inside: dict[tuple[int, ...], int] = {}  # prose of articles that have no such name, in elements that have
    for b in named:
        if b.main and b.names[-1] == 0:
            inside[b.names] = inside.get(b.names, 0) + b.prose(any_language)
    best = max(inside, key=inside.get, default=())
    if inside.get(best, 0) > kept:
        read.update(best)
    return read


def decide(blocks: list[Block], weak: set[int] = frozenset()) -> None:
    """Both passes: sets every block's label, True for main text."""
    foreign = not any(b.prose(False) for b in blocks if not b.off)  # none of the four languages
    read = _read_after_all(blocks, weak, foreign)
    for b in blocks:
        b.off = b.off or not read.issuperset(b.names)
    if not foreign:
        foreign = not any(b.prose(False) for b in blocks if not b.off)
    in_main = sum(b.prose(foreign) for b in blocks if b.main and not b.off)
    has_main = any(b.main and not b.off for b in blocks) and in_main >= MAIN_LEAST * sum(b.prose(foreign) for b in blocks if not b.off)
    for b in blocks:
        stops = b.stops
        if b.off or (has_main and not b.main) or b.linked > LINKS_MOST * len(b.text):
            b.label = False
        elif b.prose(foreign):
            b.label = True
        elif len(b.text) >= LONG:
            b.label = stops >= STOPS_LOW or None if b.main else stops >= STOPS_LOW
    labels = [b.label for b in blocks]
    inner_before, inner_after = _nearest(blocks, labels, True), _nearest(blocks[::-1], labels[::-1], True)[::-1]
    before, after = _nearest(blocks, labels, False), _nearest(blocks[::-1], labels[::-1], False)[::-1]
    for i, b in enumerate(blocks):
        if labels[i] is None:
            near = [x for x in (inner_after[i], inner_before[i]) if x] or (not b.main and [x for x in (after[i], before[i]) if x])
            b.label = min(near, key=lambda x: x[0])[1] if near else True


def _nearest(blocks: list[Block], labels: list, inside: bool) -> list:
    """(distance, label) of the last decided block before each; `inside`: in
    the same main element or, outside of any, the same container."""
    out, last = [], {}
    for i, (b, label) in enumerate(zip(blocks, labels, strict=True)):
        key = (b.main or -b.home) if inside else None
        out.append((i - last[key][0], last[key][1]) if key in last else None)
        if label is not None and not (inside and b.off):
            last[key] = (i, label)
    return out


def main_text(page: str | None) -> str:
    """The main text of one page: its blocks joined by a line feed."""
    if not page:
        return ""
    blocks, weak = blocks_of(page)
    decide(blocks, weak)
    return "\n".join(b.text for b in blocks if b.label)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: id, url, `text`, `n_chars` (code points).

    Null or empty HTML, and pages all furniture, have the empty text; nothing
    is capped. Where no block has the stop words of the four languages, length
    and links decide. Broken markup is read on: an unclosed tag ends with its block,
    an unclosed script or comment with the page, unclosed furniture at the next
    article or main element. A page without any decided
    block keeps its undecided ones. Repeated rows and null ids stay as they
    are; other columns are not read. Pages are independent: one narrow pass,
    no shuffle, one Arrow batch in memory.
    """
    fields = [pages.schema[id_col], pages.schema[url_col]]
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["_id", "_url", "text", "n_chars"]
            )

    schema = f"_id {fields[0].dataType.simpleString()}, _url {fields[1].dataType.simpleString()}, text string, n_chars long"
    return rows.mapInArrow(run, schema).withColumnsRenamed({"_id": id_col, "_url": url_col})
