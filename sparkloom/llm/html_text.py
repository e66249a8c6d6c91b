"""Main text of web pages by block rules in two passes.

Markup is cut into blocks. Pass 1 decides by link density, length and stop-word density: many links make a block bad, long
prose makes it good, and what is short or unlike prose stays ambiguous. In an article a block of links is bad in a row of
LINK_ROW of them, and ambiguous alone. Where a block stands comes second: nothing in a menu, footer, advert,
form or comment section becomes good, nor anything outside of the article if the page marks one; names that may as well tell
what a text is about (WEAK_NAMES) only decide what the rules leave open. Pass 2 gives each ambiguous block the label
of its nearest decided neighbour outside of such places, where each border of a container counts as BORDER blocks; a block of an article looks
within that article. Pages are independent of each other: there is no shuffle. A page is read in one scan, in time
proportional to its length.

Defined cases: null and empty html give the empty text; where no block of a page or article can be decided, its
ambiguous blocks are good; broken markup is read as far as it goes: an element that isn't closed ends with its container,
a tag, comment, script or style that isn't closed goes to the end of the page, a quote that isn't closed is no quote;
repeated rows are kept; an empty table gives an empty result; further columns pass through, except those that clash with
the result's.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm import _text as tx
from sparkloom.llm.quality import _schema, _with_columns

LONG_WORDS = 25
MAX_LINKS = 0.35
MIN_STOP = 0.2
BORDER = 3
LINK_ROW = 3

# Frequent function words of the languages served.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so "
    "der die und das von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux d'un cette ou ses mais comme on nous sa fait être "
    "el los las y del se por con una su para como más pero sus ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante".split()
)

_RAW = {name: re.compile(rf"</{name}(?![a-z0-9])[^>]*>?", re.I) for name in "script style noscript template textarea select svg button".split()}
#: These go to the end of the page where they aren't closed; the tags of the others are passed over then.
_RAW_TO_THE_END = frozenset("script style textarea".split())
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
_VALUE = re.compile(r"[>=]")
_WHITE = re.compile(r"\s*")
_CONTAINER = frozenset("html head body div section article main header footer nav aside form ul ol dl table fieldset figure details dialog menu blockquote center title address".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr pre hr caption figcaption summary tbody thead tfoot legend".split())
_SPACE = frozenset("br td th wbr img".split())
_BAD_TAG = frozenset("head header footer nav aside form dialog menu title fieldset".split())
STRONG_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense banner cookie cookies consent gdpr notice notices disclaimer menu nav navbar navigation breadcrumb breadcrumbs sidebar widget comment comments disqus respond replies "
    "footer masthead topbar promo promotion sponsor sponsored related recommended newsletter subscribe pagination contentinfo complementary".split()
)
WEAK_NAMES = frozenset("side search social share sharing tag tags alert skip header login signup popup modal overlay toolbar pager copyright".split())
#: Parts of names that say nothing of their own.
_PLAIN_NAMES = frozenset("list box bar block wrapper wrap container section area panel item items link links text content top bottom left right inner outer site page global primary secondary small large form button buttons".split())
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    """place: blocks and borders before it. article: the number of the article that it is in, or -1. weak_place: only a weak name says so."""

    text: str
    words: int
    link_share: float
    stop_share: float
    bad_place: bool
    weak_place: bool
    article: int
    place: int
    label: str = ""
    why: str = ""


def _named(value: str) -> int:
    """2 if one of the names in a class, id or role is a strong one, 1 if one is weak; compounds count if all their parts are such or plain."""
    found = 0
    for name in value.lower().split():
        parts = [x for x in re.split(r"[-_]+", name) if x]
        if all(x in STRONG_NAMES or x in WEAK_NAMES or x in _PLAIN_NAMES for x in parts):
            found = max(found, 2 if any(x in STRONG_NAMES for x in parts) else int(any(x in WEAK_NAMES for x in parts)))
    return found


def _attributes(raw: str) -> tuple[int, bool]:
    """How strongly (0, 1, 2) the attributes name boilerplate or hide the element, and whether they name the main part."""
    bad, main = 0, False
    for name, value in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            bad = max(bad, _named(value))
            main |= value.lower() in ("main", "article")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and bool(_HIDDEN.search(value))):
            bad = 2
    return 0 if main else bad, main


def tokens(page: str) -> Iterator[tuple[str, bool, str]]:
    """(name, whether it ends, attributes) of each tag and ("", False, text) of each text, in one scan."""
    at, size = 0, len(page)
    no_more: set[str] = set()  # what a search to the end of the page has missed

    def end_of_tag(pos: int) -> int:
        while True:
            m = _VALUE.search(page, pos)
            if not m:
                return size
            pos = m.end()
            if m[0] == ">":
                return pos
            pos = _WHITE.match(page, pos).end()
            quote = page[pos : pos + 1]
            if quote in ("'", '"') and quote not in no_more:
                close = page.find(quote, pos + 1)
                if close < 0:
                    no_more.add(quote)
                else:
                    pos = close + 1

    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield "", False, page[at:]
            return
        if start > at:
            yield "", False, page[at:start]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        m = _NAME.match(page, start + 1)
        if not m:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                end = page.find(">", start)
                at = size if end < 0 else end + 1
            else:
                yield "", False, "<"
                at = start + 1
            continue
        name, ending = m[1].lower(), page[start + 1] == "/"
        at = end_of_tag(m.end())
        if name not in _RAW:
            yield name, ending, page[m.end() : at - 1]
        elif not ending and name not in no_more:
            close = _RAW[name].search(page, at)
            if close:
                at = close.end()
            else:
                no_more.add(name)
                at = size if name in _RAW_TO_THE_END else at


def blocks(page: str) -> list[Block]:
    """The blocks of a page in page order."""
    found: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, -1)]  # tag, how bad it or one around it is, article
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    links: list[str] = []
    in_link = False
    leaf_bad = borders = articles = 0

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = text.lower().split()
            linked = len(" ".join(html.unescape("".join(links)).split()))
            stop = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words)
            bad = max(leaf_bad, stack[-1][1])
            found.append(Block(text, len(words), linked / len(text), stop / len(words), bad == 2, bad == 1, stack[-1][2], len(found) + BORDER * borders))
        parts.clear()
        links.clear()

    for tag, ending, rest in tokens(page):
        if not tag:
            parts.append(rest)
            if in_link:
                links.append(rest)
        elif tag == "a":
            in_link = not ending
        elif tag in _SPACE:
            parts.append(" ")
        elif tag in _CONTAINER:
            close()
            in_link, leaf_bad = False, 0
            if not ending:
                borders += 1
                bad, main = _attributes(rest) if rest.strip(" /") else (0, False)
                article = stack[-1][2]
                if main or tag in ("article", "main"):
                    article, articles = articles, articles + 1
                stack.append((tag, max(stack[-1][1], bad, 2 * (tag in _BAD_TAG)), article))
                open_tags[tag] += 1
            elif open_tags[tag]:
                borders += 1
                gone = None
                while gone != tag:
                    gone = stack.pop()[0]
                    open_tags[gone] -= 1
        elif tag in _LEAF:
            close()
            leaf_bad = _attributes(rest)[0] if not ending and rest.strip(" /") else 0
    close()
    return found


def classify(found: list[Block]) -> list[Block]:
    """Labels good or bad for every block, and why: links, prose, place or neighbour."""
    has_article = any(b.article >= 0 and not b.bad_place for b in found)
    row, rows = [], set()
    for i, b in enumerate([*found, None]):
        if b is not None and b.link_share > MAX_LINKS and (not row or found[row[-1]].article == b.article):
            row.append(i)
            continue
        rows |= set(row) if len(row) >= LINK_ROW else set()
        row = [i] if b is not None and b.link_share > MAX_LINKS else []
    for i, b in enumerate(found):
        if b.link_share > MAX_LINKS and (b.article < 0 or b.bad_place or i in rows):
            b.label, b.why = "bad", "links"
        elif b.bad_place or (has_article and b.article < 0):
            b.label, b.why = "bad", "place"
        elif b.words >= LONG_WORDS and b.link_share <= MAX_LINKS and b.stop_share >= MIN_STOP:
            b.label, b.why = "good", "prose"
        elif b.weak_place:
            b.label, b.why = "bad", "place"
    nearest: dict[int, tuple[int, str]] = {}
    for order in (found, reversed(found)):
        last: dict[int, Block] = {}
        for i, b in zip(range(len(found)) if order is found else range(len(found) - 1, -1, -1), order, strict=True):
            own = b.article if b.article >= 0 else -1
            if not b.label:
                if own in last and (i not in nearest or abs(b.place - last[own].place) < nearest[i][0]):
                    nearest[i] = (abs(b.place - last[own].place), last[own].label)
            elif not b.bad_place and not (b.weak_place and b.why == "place"):
                last[own] = b
    for i, b in enumerate(found):
        if not b.label:
            b.label, b.why = (nearest[i][1], "neighbour") if i in nearest else ("good", "place")
    return found


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in classify(blocks(page or "")) if b.label == "good")


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the html column, with text string and n_chars long (code points)."""
    source = pages.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tx.slices(batch, column):
                texts = [main_text(p) for p in rows.column(column).to_pylist()]
                yield _with_columns(rows.drop_columns([column]), {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.mapInArrow(run, _schema(source, {"text": "string", "n_chars": "bigint"}))
