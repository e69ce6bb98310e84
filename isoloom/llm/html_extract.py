"""Main-text extraction from HTML by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides each block by itself: what stands
in navigation, headers, footers, asides, forms or elements named like adverts, notices or comments is
boilerplate, so is a block made of links or a short one with a copyright sign. Long enough blocks with enough stop words
are text. The rest stays undecided: headings, short blocks and long ones without stop words. The second pass
gives an undecided block the label of its nearest decided neighbours. All this holds inside and outside article
and main elements alike; their borders only make neighbours more distant.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import blocks

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and are as at be been but by can could do for from had has have he her his how i if in into is it its just
    more my no not of on one only or other our out over she so some than that the their them then there these they this to up was we were
    what when which who will with would you your
    à au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais me même ne nous on ont ou où par pas
    pour plus qu que qui sa se ses si son sont sur tu un une vous y
    aber als am auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer eines er es für hat hatte
    ich ihr im in ist ja kann mit nach nicht noch nur oder sehr sein sich sie sind so über um und uns unter vom von vor war was wenn werden
    wie wir wird zu zum zur
    al como con cuando de del desde donde el ella ellos en entre era es esa ese eso esta este esto fue ha hasta hay la las lo los más me mi
    muy ni no nos o para pero por porque que se ser si sin sobre son su sus también te tiene todo un una uno y ya""".split()
)
#: Element names.
BLOCK = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td
    template tfoot th thead tr ul""".split()
)
RAW = frozenset("script style noscript template textarea title svg annotation annotation-xml iframe object audio video canvas noembed noframes head".split())
#: Of these, what has no end tag goes on to the page's end; the others are left out as tags only.
ENDLESS = frozenset(("script", "style", "textarea"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD = frozenset("nav header footer aside form menu button select option label input dialog".split())
MAIN = frozenset(("article", "main"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id attributes. The first name boilerplate whatever stands beside them; the second only
#: in names made of such words, the third and numbers: `social-links` does, `social-policy` and `post-header` do not.
BAD_NAMES = frozenset(
    """ads adv advert advertisement adverts advertising breadcrumb breadcrumbs comments commentlist cookie cookies disqus footnav
    navbar newsletter pagination paywall sidebar signup skyscraper sponsored toolbar topbar""".split()
)
WEAK_NAMES = frozenset(
    """ad banner comment consent copyright dropdown footer header masthead menu menubar modal nav navigation navi notice notices overlay pager
    popup promo promoted promotion recommended related replies reply respond reviews share sharing skip social sponsor subscribe
    subscription teaser widget widgets""".split()
)
NEUTRAL_NAMES = frozenset(
    """a area articles author bar block body bottom box btn button buttons card cards col column container content count feed fixed form group
    head icon icons inline inner is item items left legal link links list main meta mobile more next outer page panel posts primary right row
    secondary section site slot small stories sub text thread title to top unit wrap wrapper""".split()
)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

SHORT, LINKS, STOPS = 70, 0.33, 0.2
#: Blocks that an element's border adds to the distance of a neighbour.
BORDER = 16
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    links: int = 0
    bad: bool = False
    main: bool = False
    heading: bool = False
    text: str = ""
    label: str = ""


def names_boilerplate(value: str) -> bool:
    """Whether a class or id attribute names boilerplate: one of its names, split at capitals and signs, does."""
    for name in value.split():
        parts = set(_NAME.findall(_CAMEL.sub("-", name).lower()))
        if not parts.isdisjoint(BAD_NAMES) or not parts.isdisjoint(WEAK_NAMES) and parts <= WEAK_NAMES | NEUTRAL_NAMES:
            return True
    return False


def _is_bad(name: str, attrs: str) -> bool:
    if name in BAD:
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    for key, value in _ATTR.findall(attrs):
        key, given = key.lower(), value.strip("\"'")
        value = given.lower()
        if key in ("class", "id") and names_boilerplate(given):
            if name not in ("body", "html"):
                return True
        if key == "role" and value in BAD_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def parse(html: str) -> list[Block]:
    """Blocks of a page in order, with what their elements say of them. Never fails, whatever the markup."""
    out: list[Block] = []
    now = Block()
    stack: list[tuple[str, bool]] = []
    opened: dict[str, int] = {}  # open elements by name, so that stray end tags cost nothing
    endless: set[str] = set()  # names without any further end tag
    bad = main = heading = anchors = 0

    def close() -> None:
        nonlocal now
        now.text = " ".join(entities.unescape("".join(now.parts)).split())
        if now.text:
            out.append(now)
        now = Block()

    def add(piece: str) -> None:
        if not now.parts:
            now.bad, now.main, now.heading = bad > 0, main > 0, heading > 0
        now.parts.append(piece)
        if anchors:
            now.links += len("".join(piece.split()))

    def leave(count: int) -> None:
        nonlocal bad, main, heading, anchors
        for name, was_bad in stack[len(stack) - count :]:
            opened[name] -= 1
            bad -= was_bad
            main -= name in MAIN
            heading -= name in HEADING
            anchors -= name == "a"
        del stack[len(stack) - count :]

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        if lt > at:
            add(html[at:lt])
        m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if not m:
            if html[lt + 1 : lt + 2].isalpha() or html[lt + 1 : lt + 2] == "/":
                break  # a tag cut off at the end of the page
            add("<")
            at = lt + 1
            continue
        at = m.end()
        if m.lastindex is None or m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in BLOCK:
            close()
        elif name == "br":
            add(" ")
        if closing:
            for back in range(1, len(stack) + 1 if opened.get(name) else 1):
                if stack[-back][0] == name:
                    leave(back)
                    break
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):
            pattern = r"</head\s*>|<body[\s>]" if name == "head" else rf"</{re.escape(name)}\s*>"
            end = None if name in endless else re.compile(pattern, re.I).search(html, at)
            if not end:
                endless.add(name)
            if name == "head":
                if end:
                    at = end.start() if end[0][1] != "/" else end.end()
                continue
            at = end.end() if end else n if name in ENDLESS else at
            continue
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        if name in BLOCK and stack and stack[-1][0] in ("p", "li", "dt", "dd", "td", "th", "tr", "option", *HEADING) and (stack[-1][0] == name or stack[-1][0] == "p"):
            leave(1)  # an end tag was left out
        was_bad = _is_bad(name, m[3])
        stack.append((name, was_bad))
        opened[name] = opened.get(name, 0) + 1
        bad += was_bad
        main += name in MAIN
        heading += name in HEADING
        anchors += name == "a"
    close()
    return out


def first_pass(found: list[Block]) -> None:
    """Decide each block by itself: bad, good, or undecided."""
    for b in found:
        words = _WORD.findall(b.text.lower())
        stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        density = b.links / max(1, len(b.text) - b.text.count(" "))
        if b.bad or density > LINKS or "©" in b.text and len(b.text) < SHORT:
            b.label = "bad"
        elif b.heading or len(b.text) < SHORT or stops < STOPS:
            b.label = ""
        else:
            b.label = "good"


def second_pass(found: list[Block]) -> None:
    """Give undecided blocks the label of the nearest decided block.

    Blocks on the other side of an article's or main element's border, or in an element that is boilerplate
    by name, are `BORDER` blocks farther. At equal distance good wins, but not outside the article or main
    elements of a page that has good text in them. A page with nothing decided good keeps its undecided blocks.
    """
    labels = [b.label for b in found]
    if "good" not in labels:
        for b in found:
            b.label = b.label or "good"
        return
    outside = any(b.main and b.label == "good" for b in found)
    nearest = [{"good": len(found) + 3 * BORDER, "bad": len(found) + 3 * BORDER} for _ in found]
    for order in (range(len(found)), reversed(range(len(found)))):
        last: dict[tuple[str, bool, bool], int] = {}
        for i in order:
            b = found[i]
            if labels[i]:
                last[labels[i], b.main, b.bad] = i
                continue
            for (label, main, bad), j in last.items():
                nearest[i][label] = min(nearest[i][label], abs(i - j) + BORDER * ((main != b.main) + bad))
    for i, b in enumerate(found):
        if not labels[i]:
            good, bad = nearest[i]["good"], nearest[i]["bad"]
            b.label = "good" if good < bad or good == bad and (b.main or not outside) else "bad"


def extract(html: str | None) -> str:
    """The page's main text: good blocks in page order, joined by a blank line."""
    found = parse(html or "")
    first_pass(found)
    second_pass(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of `pages` but `html`, and `text` and `n_chars` (its code points).

    A null or empty page has an empty text. Every row stays. Columns named like results are replaced.
    One pass without shuffle; a worker holds one block of pages.
    """
    kept = pages.drop(*[c for c in ("text", "n_chars") if c != html])
    rest = [c for c in kept.columns if c != html]
    schema = kept.select(*[f"`{c}`" for c in rest], F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema]
        for batch in blocks(batches, html):
            texts = [extract(h) for h in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    return kept.mapInArrow(run, schema)
