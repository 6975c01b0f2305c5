"""Main text of web pages: blocks are classified by stop words, length and links, ambiguous ones by neighbours."""

from __future__ import annotations

import html
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices

#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas textarea select button title datalist".split())
#: Elements around the main text, never in it.
OUTER = frozenset("nav header footer aside form menu dialog".split())
#: Elements that hold it.
MAIN = frozenset(("article", "main"))
#: Elements that end a block of text before and after themselves.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Class and id names of what surrounds a text, alone or joined with each other and with FILLERS.
OUTER_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus disclaimer dropdown "
    "footer footnav form header login menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion "
    "related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget".split()
)
FILLERS = frozenset(
    "area bar block bottom box button buttons container global icons inner item items left link links list main mobile page post primary right secondary "
    "section site text top wrap wrapper".split()
)
#: Names of readers' and other texts, which can be longer than the page's own.
OTHER_TEXTS = frozenset("comment comments disqus related reply replies respond".split())
#: Elements that no name makes part of what surrounds a text.
KEPT = frozenset(("html", "body", *MAIN))
OUTER_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())

#: Frequent function words of the languages that the classifier knows.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can for from had has have he her his if in into is it its more no not of on one or our she so "
    "some than that the their them there they this to was we were what when which who will with would you your "
    "au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais même nous on ou par pas plus pour qu que qui sa se ses "
    "son sont sur un une vous être "
    "als am an auch auf aus bei das dem den der des die durch ein eine einem einen einer es für haben hat ich im in ist mit nach nicht noch nur oder sich sie "
    "sind so über um und von vor war wie wird zu zum zur "
    "al como con de del el en entre era es esta este ha la las lo los más me no o para pero por que se sin sobre su sus un una y ya".split()
)

#: Bounds of the first pass: characters of short and long blocks, shares of stop words and of link text.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, LINKS = 0.15, 0.30, 0.33
#: Bound of links in a main element: softer, as its element speaks for a block.
LINKS_MAIN = 0.8
#: A page with less than this share of stop words, by length of its blocks, is in a language without known ones.
STOP_PAGE = 0.08
#: Letters of scripts without spaces; one says as much as three of an alphabet.
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
_AROUND = string.punctuation + "«»„“”‘’…–—¿¡·©"

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_PART = re.compile(r"[A-Za-z]+")
_SPACES = re.compile(r"\s+")
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE) for name in SILENT}


@dataclass(eq=False)
class Mark:
    """An element whose class, id or role says that it surrounds the text."""

    number: int
    outer: Mark | None
    other_text: bool
    holds_main: bool = False
    chars: int = 0
    bad: bool = False


@dataclass
class Block:
    text: str
    links: int
    place: str  # "outer", "main" or ""
    heading: bool = False
    part: int = 0  # which outermost main element holds it, 0: none
    mark: Mark | None = None
    stops: float = -1.0  # share of stop words, -1: too short to tell
    label: str = field(default="")


def _named(attributes: str) -> set[str]:
    """The names and roles of what surrounds a text among an element's attributes."""
    out: set[str] = set()
    for name, *values in _NAMES.findall(attributes) if "=" in attributes else ():
        for token in "".join(values).lower().split():
            if name.lower() == "role":
                out |= {token} & OUTER_ROLES
                continue
            parts = set(_PART.findall(token))
            if parts <= OUTER_NAMES | FILLERS:
                out |= parts & OUTER_NAMES
    return out


def blocks(page: str) -> list[Block]:
    """The page's blocks in order. Unclosed and stray tags are tolerated: an end tag closes what it finds open."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, str, int, Mark | None]] = []  # open elements, the place, part and mark around them
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()
    place, anchors, heading, at = "", 0, False, 0
    part = parts_seen = marks_seen = 0
    mark: Mark | None = None
    paragraph: tuple[str, Mark | None] | None = None  # the place and mark around an open paragraph that has its own

    def marked(attributes: str) -> None:
        nonlocal mark, marks_seen
        if names := _named(attributes):
            marks_seen += 1
            mark = Mark(marks_seen, mark, bool(names & OTHER_TEXTS))

    def flush() -> None:
        nonlocal heading, place, mark, paragraph
        text = _SPACES.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            links = len(_SPACES.sub(" ", html.unescape("".join(linked))).strip())
            out.append(Block(text, links, place, heading, part, mark))
        parts.clear()
        linked.clear()
        if paragraph:  # any block's start or end ends a paragraph
            (place, mark), paragraph = paragraph, None

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if anchors:
                linked.append(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCK:
                flush()
            if name == "a":
                anchors = max(0, anchors - 1)
            elif opened[name]:
                inner = ""
                while inner != name:
                    inner, place, part, mark = stack.pop()
                    opened[inner] -= 1
            if name[:1] == "h" and name[1:] in "123456":
                heading = False
            continue
        if name in SILENT:
            if name in BLOCK:
                flush()
            if m[3].rstrip().endswith("/"):
                continue
            end = None if name in unclosed else _CLOSE[name].search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
            else:
                unclosed.add(name)
            continue
        if name == "br":
            parts.append(" ")
        if name == "a":
            anchors += 1
        if name in BLOCK:
            flush()
            anchors = 0 if name not in ("li", "p", "div", "span") else anchors
            if name != "p" and name not in VOID:
                stack.append((name, place, part, mark))
                opened[name] += 1
                if place != "outer":
                    if name in OUTER and not (name == "header" and place == "main") or name not in ("html", "body") and _HIDDEN.search(m[3]):
                        place = "outer"
                    elif name in MAIN:
                        if place != "main":
                            parts_seen += 1
                            part = parts_seen
                        place = "main"
                        above = mark
                        while above and not above.holds_main:
                            above.holds_main = True
                            above = above.outer
                    if place != "outer" and name not in KEPT:
                        marked(m[3])
            elif name == "p" and place != "outer":
                paragraph = (place, mark)
                if _HIDDEN.search(m[3]):
                    place = "outer"
                marked(m[3])
            heading = name[:1] == "h" and name[1:] in "123456" and len(name) == 2
    flush()
    return out


def _stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(_AROUND) in STOP_WORDS for w in words) / max(1, len(words))


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


def _language_known(found: list[Block]) -> bool:
    rows = [b for b in found if b.place != "outer" and b.stops >= 0 and b.links / len(b.text) <= LINKS]
    chars = sum(len(b.text) for b in rows)
    return not chars or sum(b.stops * len(b.text) for b in rows) >= STOP_PAGE * chars


def _first(b: Block, language_known: bool = True) -> str:
    """A block's label by itself: "good" or "bad", or open: "near", "short" or "links"."""
    if b.place == "outer":
        return "bad"
    density, main = b.links / len(b.text), b.place == "main"
    if main and density > LINKS_MAIN and len(b.text) - b.links < SHORT:
        return "links"
    if not main and density > LINKS:
        return "bad"
    if "©" in b.text and len(b.text) < LONG:
        return "links" if main else "bad"
    if not language_known:  # length has to decide alone
        size = _size(b.text)
        return "good" if size > LONG else "near" if size >= SHORT else "short"
    if len(b.text) < SHORT:
        return "short"
    if main:
        return "good" if b.stops >= STOP_LOW else "near"
    if b.stops >= STOP_HIGH:
        return "good" if len(b.text) > LONG else "near"
    return "near" if b.stops >= STOP_LOW else "bad"


def _neighbours(found: list[Block], edge: str) -> None:
    """Labels the open blocks by the nearest decided ones among those given; beyond the ends lies `edge`."""
    decided = [b.label if b.label in ("good", "bad") else "" for b in found]
    before, last = [], edge
    for d in decided:
        before.append(last)
        last = d or last
    after, last = [], edge
    for d in reversed(decided):
        after.append(last)
        last = d or last
    after.reverse()
    for b, d, left, right in zip(found, decided, before, after, strict=True):
        if d:
            continue
        if b.label == "links":
            b.label = "good" if left == right == "good" else "bad"
        elif b.heading:
            b.label = right
        elif left == right:
            b.label = left
        elif edge == "good":
            b.label = "good"
        else:
            b.label = "good" if b.label == "near" else "bad"


def _discard_named(found: list[Block]) -> None:
    """Makes blocks bad whose elements' names say so, unless these elements hold a main element or most of the page's
    good text. Readers' and other texts may do both, as long as good text is left outside them."""
    marks: dict[int, Mark] = {}
    for b in found:
        mark = b.mark
        while mark and mark.number not in marks:
            marks[mark.number] = mark
            mark = mark.outer
    if not marks:
        return
    good = [b for b in found if b.label == "good"]
    if not good and not any(b.place == "main" for b in found):
        good = [b for b in found if b.label == "near"]
    for b in good:
        if b.mark:
            b.mark.chars += len(b.text)
    for n in sorted(marks, reverse=True):
        if marks[n].outer:
            marks[n].outer.chars += marks[n].chars
    total = sum(len(b.text) for b in good)
    for n in sorted(marks):
        mark = marks[n]
        kept = mark.holds_main or 2 * mark.chars > total
        if mark.other_text:
            kept = kept and mark.chars == total
        mark.bad = not kept or mark.outer is not None and mark.outer.bad
    for b in found:
        if b.mark and b.mark.bad:
            b.label, b.place = "bad", "outer"


def classify(found: list[Block]) -> list[Block]:
    """Labels each block "good" or "bad".

    First pass, block by block: what lies outside the main text by its elements is bad, as is what does by its names if
    these do not hold a main element or most of the good text; elsewhere link
    density, length and stop-word density decide, and short or middling blocks stay open. A main element only softens
    the bounds: fewer stop words make a block good, none leave it open, and more links are let pass. Second pass: an
    open block takes the label of its nearest decided neighbours; between two kinds a near-good one counts as good, a
    short one as bad, and a heading looks ahead. In a main element with good text, or where no block of the page is
    good, only blocks of that element are neighbours and doubt speaks for the text; blocks of links or of copyright
    before its first or after its last text are bad. A main element without good text on a page that has some is judged like the
    rest of the page. On a page in a language without known stop words, length decides in their place.
    """
    for b in found:
        if b.place != "outer" and _size(b.text) >= SHORT:
            b.stops = _stop_share(b.text)
    language_known = _language_known(found)
    for b in found:
        b.label = _first(b, language_known)
    _discard_named(found)
    known = {b.part for b in found if b.label == "good"}
    inside: dict[int, list[Block]] = {}
    for b in found:
        if b.place == "main" and (b.part in known or not known):
            inside.setdefault(b.part, []).append(b)
    for section in inside.values():
        texts = [k for k, b in enumerate(section) if b.label != "links"]
        for k, b in enumerate(section):
            if b.label == "links":  # between texts open, before the first or after the last bad
                b.label = "short" if texts and texts[0] < k < texts[-1] else "bad"
        _neighbours(section, "good")
    _neighbours(found, "bad")
    return found


def extract(page: str | None) -> str:
    """The main text of a page; empty if there is none."""
    return " ".join(b.text for b in classify(blocks(page)) if b.label == "good") if page else ""


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars. One pass without a shuffle over each whole page.

    A null or empty page has an empty text; null ids and urls and repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [extract(h) for h in b.column(2).to_pylist()]
            arrays = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html_column).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
