"""Main text of HTML pages by two-pass block rules.

A page becomes a list of text blocks. The first pass decides what it can: markup that names a menu, header,
form and the like is boilerplate; so are blocks made of links; long blocks with enough stop words are text. On a
page whose language the stop words do not know, length and links alone decide. The second pass gives all other
blocks the label of their nearest decided neighbours: those inside an article or main element look at one another,
those outside at all.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import row_slices

MAX_LINK_DENSITY = 0.33
SHORT_CHARS = 70
LONG_CHARS = 140
LOW_STOPWORDS = 0.12
HIGH_STOPWORDS = 0.25
#: A page whose text has a smaller share of stop words is in a language that they do not know.
KNOWN_STOPWORDS = 0.05

#: Frequent function words of English, German, French and Spanish.
STOPWORDS = frozenset(
    (
        "a an and are as at be been but by can for from had has have he her his i in is it its not of on or she so that the their "
        "them then there they this to was we were which who will with you "
        "als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist "
        "mit nach nicht noch nur oder sein sich sie sind über um und von war wie wir zu zum zur "
        "au aux avec ce ces dans de du elle en est et il ils la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa "
        "se ses son sur un une vous "
        "al como con del el ella en entre era es esta este ha las lo los más me mi muy no nos o para pero por que se si sin sobre "
        "su sus también una uno y ya"
    ).split()
)

#: A tag up to its end: a > inside a quoted value does not end it.
_TAG = re.compile(r"(?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+>")
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>", re.I) for t in "script style noscript template iframe svg textarea select title object".split()}
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[a-z]+")

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open paragraph or item of the same kind.
SELF_CLOSING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
SCOPES = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html main menu nav ol section table ul".split())
BOILERPLATE_TAGS = frozenset("head nav header footer aside form button dialog menu label fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Parts of class and id names that mark boilerplate, and those that mark the text.
BOILERPLATE_NAMES = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer disqus foot footer gdpr head header login masthead menu menus modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
MAIN_NAMES = frozenset("article content main post entry story body text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ALWAYS_BOILERPLATE = frozenset("comment comments disqus replies reply respond ad ads advert advertisement sidebar cookie cookies newsletter".split())


@dataclass
class Block:
    text: str
    link_chars: int
    boilerplate: bool
    in_main: bool
    heading: bool = False

    def link_density(self) -> float:
        return self.link_chars / max(1, len(self.text))

    def stopwords(self) -> tuple[int, int]:
        """How many stop words, and how many words."""
        words = [w.strip(".,;:!?\"'()[]%#*&$|-") for w in self.text.lower().split()]
        return sum(w in STOPWORDS for w in words), len(words)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _is_boilerplate(tag: str, attributes: str) -> bool:
    if tag in ("html", "body", "main", "article"):
        return False
    if tag in BOILERPLATE_TAGS:
        return True
    if not attributes.strip():
        return False
    a = _attributes(attributes)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in BOILERPLATE_ROLES or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    names = set(_NAME_PART.findall(f"{a.get('class', '')} {a.get('id', '')}".lower()))
    return bool(names & ALWAYS_BOILERPLATE) or bool(names & BOILERPLATE_NAMES) and not names & MAIN_NAMES


def _is_main(tag: str, attributes: str) -> bool:
    return tag in MAIN_TAGS or "role" in attributes and _attributes(attributes).get("role", "").lower() in ("main", "article")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") in page order, in linear time.

    Comments, declarations and the content of scripts and the like are passed over; what only looks like markup
    is text. Elements passed over come as one "raw" token.
    """
    at, quotes, last = 0, True, page.rfind(">")
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at:
            yield "text", page[at:start], ""
        if start == len(page):
            return
        at = start
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
        elif start > last:
            yield "text", "<", ""
            at = start + 1
        elif page[start + 1] in "!?":
            at = page.find(">", start) + 1
        elif name := _NAME.match(page, start):
            end = _TAG.match(page, name.end()) if quotes else None
            if end is None:  # a quote that nothing closes: from here on quotes mean nothing
                quotes = False
            at = end.end() if end else page.find(">", name.end()) + 1
            tag = name[2].lower()
            if name[1]:
                yield "close", tag, ""
            elif tag in _RAW_END:
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
                yield "raw", tag, ""
            else:
                yield "open", tag, page[name.end() : at - 1]
        else:
            yield "text", "<", ""
            at = start + 1


class _Open:
    """The open elements, and where the last of each name, each scope and each block stands: every step is constant."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = [-1]
        self.blocks: list[int] = [-1]
        self.bad = self.main = self.links = self.headings = 0

    def push(self, tag: str, bad: bool, main: bool) -> None:
        where = len(self.stack)
        self.stack.append((tag, bad, main))
        self.at.setdefault(tag, []).append(where)
        if tag in SCOPES:
            self.scopes.append(where)
        if tag in BLOCK_TAGS:
            self.blocks.append(where)
        self._count(1, tag, bad, main)

    def _count(self, n: int, tag: str, bad: bool, main: bool) -> None:
        self.bad, self.main, self.links, self.headings = self.bad + n * bad, self.main + n * main, self.links + n * (tag == "a"), self.headings + n * (tag in HEADINGS)

    def last(self, tag: str) -> int:
        found = self.at.get(tag)
        return found[-1] if found else -1

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            tag, bad, main = self.stack.pop()
            self.at[tag].pop()
            for many in (self.scopes, self.blocks):
                if many[-1] == len(self.stack):
                    many.pop()
            self._count(-1, tag, bad, main)


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, with what the open elements around each say of it."""
    found: list[Block] = []
    parts: list[str] = []
    link_chars, now = 0, _Open()

    def flush() -> None:
        nonlocal parts, link_chars
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, link_chars, now.bad > 0, now.main > 0, now.headings > 0))
        parts, link_chars = [], 0

    for kind, tag, attributes in tokens(page):
        if kind == "text":
            text = html.unescape(tag)
            parts.append(text)
            if now.links:
                link_chars += len("".join(text.split()))
            continue
        if kind == "raw":
            if tag in ("title", "textarea", "select", "iframe", "object"):
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
        if kind == "close":
            where = now.last(tag)
            if where >= 0 and (tag in SCOPES or where > now.scopes[-1]):
                now.cut(where)
            continue
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS:
            continue
        ends = SELF_CLOSING.get(tag) or (("p",) if tag in BLOCK_TAGS else ())
        where = max((now.last(e) for e in ends), default=-1)
        if where > now.scopes[-1]:
            now.cut(where)
        if tag == "a" and now.last("a") > now.blocks[-1]:
            now.cut(now.last("a"))
        now.push(tag, _is_boilerplate(tag, attributes), _is_main(tag, attributes))
    flush()
    return found


def knows_language(blocks: list[Block]) -> bool:
    """Whether stop words are common enough in what may be text."""
    counts = [b.stopwords() for b in blocks if not b.boilerplate and b.link_density() <= MAX_LINK_DENSITY]
    return sum(c[0] for c in counts) >= KNOWN_STOPWORDS * sum(c[1] for c in counts)


def first_pass(block: Block, known: bool) -> str:
    """``good``, ``bad``, or ``near`` if only the neighbours can tell."""
    if block.boilerplate or block.link_density() > MAX_LINK_DENSITY:
        return "bad"
    if len(block.text) < SHORT_CHARS:
        return "near"
    if not known:
        return "good"
    stop, words = block.stopwords()
    density = stop / max(1, words)
    return "good" if density >= HIGH_STOPWORDS or density >= LOW_STOPWORDS and len(block.text) >= LONG_CHARS else "near"


def second_pass(labels: list[str], headings: list[bool] | None = None) -> list[bool]:
    """Undecided blocks take the label of the nearest decided block; between two that differ at one distance they are
    no text, but a heading goes with what follows it. With no decided block at all, they are text."""
    n = len(labels)
    before, after = [None] * n, [None] * n
    last = None
    for k in range(n):
        before[k] = last
        if labels[k] != "near":
            last = k
    last = None
    for k in range(n - 1, -1, -1):
        after[k] = last
        if labels[k] != "near":
            last = k
    keep = []
    for k, label in enumerate(labels):
        if label != "near":
            keep.append(label == "good")
            continue
        a, b = before[k], after[k]
        if a is None and b is None:
            keep.append(True)
        elif a is None or b is None:
            keep.append(labels[b if a is None else a] == "good")
        elif headings and headings[k] or k - a > b - k:
            keep.append(labels[b] == "good")
        else:
            keep.append(labels[a] == "good" and (k - a < b - k or labels[b] == "good"))
    return keep


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    known = knows_language(blocks)
    labels = [first_pass(b, known) for b in blocks]
    inside = [k for k, b in enumerate(blocks) if b.in_main and not b.boilerplate]
    for k, keep in zip(inside, second_pass([labels[k] for k in inside], [blocks[k].heading for k in inside]), strict=True):
        labels[k] = "good" if keep else "bad"
    keep = second_pass(labels, [b.heading for b in blocks])
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Character references are decoded, white space inside a block becomes one space, blocks stand in page order
    with one line feed between them; nothing else is dropped or cut. Markup that names boilerplate and link density
    make blocks bad; stop-word density and length make them text, inside and outside an article alike; what that
    leaves open goes with its neighbours, with ties on the side of boilerplate. Null and empty pages, and pages
    without text, give an empty text. Pages of any length are read whole, in linear time; unclosed elements end
    where their block does. Repeated rows get equal answers, an empty table an empty result, and other columns are
    ignored.
    """

    def run(batches):
        for batch in row_slices(batches, 64):
            texts = [main_text(p.as_py()) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
