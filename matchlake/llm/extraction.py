"""Main text of web pages by block rules in two passes.

A page is cut into blocks at its block-level tags; inline tags, references and white space are resolved within a block.  Every block
knows its length, the share of its characters within links, the share of its words that are stop words, the best
container it lies in (an article element over main over a named content element), and whether an enclosing
element says that it is no main text (menus, headers, footers, sidebars, notices, adverts, forms, reader comments).

First pass: such blocks, and those dense in links, are bad; long enough ones with stop words are good, and within an article any
that are long enough; the others, short ones above all, stay open.  Second pass: an open block takes the label of the nearest decided
block of its container (of two equally near ones that differ, the good one), and is good where the container has none.
Last, where the good blocks of a better container are no shorter than half of the others, only that container counts.

A page is read once, forwards; comments, scripts and tags that never end take the rest of it, as in browsers.

Defined results: a null or empty html has the empty text; a page without any main text too; rows that share a page_id, or
have none, are pages of their own; white space is what Python's str.split takes for it; only page_id, url and html are read, so further
columns never clash; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.common import arrow_rows, read

SHORT = 70
LONG = 200
LINKED = 0.33
ALL_LINKED = 0.8  # within an article, whose sentences may well be links
STOPPED = 0.2
FEW_STOPPED = 0.08
_BATCH = 256

STOP_WORDS = frozenset(
    """the and of to in is that it for was on are as with be at by this have from or had not but what were which their an they you his her she we there been has will would who
    der die das und ist nicht ein eine einer zu den dem des mit von auf für sich im auch es er sie als wie bei nach aus war wird sind oder aber über
    le la les et est un une des du dans que qui pour pas sur ce il elle au aux avec par plus son sa ses ne se ou mais nous vous ont été
    el los las y es en del que con por para una un su sus al lo como más pero se fue ha era son sobre entre cuando también""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe template svg math select option button object video audio canvas noframes noembed xmp head".split())
_BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend
    li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
_SAID_BY_TAG = {"nav": "menu", "menu": "menu", "footer": "footer", "aside": "sidebar", "form": "form", "fieldset": "form", "label": "form", "legend": "form", "search": "form", "dialog": "notice"}
_SAID_BY_ROLE = {"navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer", "complementary": "sidebar", "search": "form", "form": "form", "alert": "notice", "alertdialog": "notice", "dialog": "notice", "toolbar": "menu"}
_SAID_BY_NAME = {
    "menu": "menu menus nav navbar navigation navi breadcrumb breadcrumbs pager pagination toc topbar toolbar skip skiplink subnav".split(),
    "header": "masthead siteheader pageheader".split(),
    "footer": "footer foot colophon copyright imprint sitefooter".split(),
    "sidebar": "sidebar sidebars aside rail sidecolumn widget widgets related recommended recommendations teaser teasers trending popular".split(),
    "notice": "notice notices cookie cookies consent gdpr banner alert popup modal overlay disclaimer paywall toast".split(),
    "advert": "ad ads adv advert adverts advertising advertisement advertisements adsense adbox adslot sponsor sponsored sponsors promo promos promotion promoted".split(),
    "form": "form newsletter subscribe subscription signup login signin search searchbox".split(),
    "comments": "comment comments commentlist commentarea respond responses replies reply disqus discussion feedback".split(),
    "share": "share sharing shares social socials".split(),
}
_NAMES = {name: kind for kind, names in _SAID_BY_NAME.items() for name in names}
_OPPOSITE = frozenset("no with has without is hide".split())
_CONTENT = frozenset("content article articlebody post story entry main maincontent body text prose".split())
#: What an article or main element inside does away with: the element around it was never closed, or holds the whole page.
_OPEN_AROUND = frozenset("menu header advert form notice".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass
class Block:
    text: str
    linked: int
    said: str | None
    grade: int
    container: int
    label: str = "open"


@dataclass
class _Element:
    """An open element, with what holds inside it."""

    tag: str
    said: str | None = None
    grade: int = 0
    container: int = 0
    link: bool = False


@dataclass
class _Reader:
    stack: list[_Element] = field(default_factory=lambda: [_Element("")])
    open: dict[str, int] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    containers: int = 0

    def text(self, raw: str) -> None:
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(plain)
            if self.stack[-1].link:
                self.linked.append(plain)

    def cut(self) -> None:
        """Ends the block that is open."""
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(text, len(" ".join("".join(self.linked).split())), top.said, top.grade, top.container))
            self.pieces.clear()
            self.linked.clear()

    def pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1

    def close(self, tag: str) -> None:
        if self.open.get(tag):
            while self.stack[-1].tag != tag:
                self.pop()
            self.pop()

    def end_inline(self, tag: str) -> bool:
        """Whether an inline element ended that has a block open inside; that block stays open."""
        if not self.open.get(tag):
            return False
        for k in range(len(self.stack) - 1, max(0, len(self.stack) - 17), -1):
            if self.stack[k].tag == tag:
                above = self.stack[k + 1 :]
                if not any(e.tag in _BLOCKS for e in above):
                    return False
                for e in above:
                    e.link = e.link and tag != "a"
                del self.stack[k]
                self.open[tag] -= 1
                return True
        return False

    def implied(self, tag: str) -> None:
        """Ends what a start tag ends."""
        if tag in _BLOCKS and self.open.get("p"):
            for e in reversed(self.stack[-16:]):
                if e.tag == "p":
                    self.close("p")
                    break
                if e.tag in _BLOCKS:
                    break
        if tag in _CLOSES:
            ends, within = _CLOSES[tag]
            for e in reversed(self.stack[-64:]):
                if e.tag in ends:
                    self.close(e.tag)
                    break
                if e.tag in within:
                    break
        elif tag == "a" and self.open.get("a"):
            self.close("a")

    def start(self, tag: str, attributes: str) -> None:
        self.implied(tag)
        above = self.stack[-1]
        said, grade, container = above.said, above.grade, above.container
        own = _attributes(attributes) if attributes else {}
        best = _grade(tag, own)
        if best >= 2 and said in _OPEN_AROUND:
            said = None
        if said is None:
            said = _said(tag, own, grade)
        if best > grade or best >= 2:
            self.containers += 1
            grade, container = max(best, grade), self.containers
        self.stack.append(_Element(tag, said, grade, container, above.link or (tag == "a" and "href" in own)))
        self.open[tag] = self.open.get(tag, 0) + 1


def _attributes(raw: str) -> dict[str, str]:
    return {name.lower(): html.unescape(a or b or c) for name, a, b, c in _ATTRIBUTE.findall(raw)}


def _class_names(own: dict[str, str]) -> Iterator[list[str]]:
    for name in f"{own.get('id', '')} {own.get('class', '')}".split():
        yield [x for x in _PARTS.split(_CAMEL.sub("-", name).lower()) if x]


def _grade(tag: str, own: dict[str, str]) -> int:
    """3: an article, 2: the main element, 1: an element whose name says content."""
    if tag == "article" or own.get("itemprop", "").lower() == "articlebody":
        return 3
    if tag == "main" or own.get("role", "").lower() == "main":
        return 2
    if tag in ("div", "section", "td") and any(len(x) <= 2 and _CONTENT & {*x} and not {*x} & _NAMES.keys() for x in _class_names(own)):
        return 1
    return 0


def _said(tag: str, own: dict[str, str], grade: int) -> str | None:
    """Why an element is no main text, or None."""
    if tag in _SAID_BY_TAG:
        return _SAID_BY_TAG[tag]
    if tag == "header" and grade < 2:
        return "header"
    if not own or tag in ("html", "body"):
        return None
    role = own.get("role", "").lower()
    if role in _SAID_BY_ROLE:
        return _SAID_BY_ROLE[role]
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", ""), re.I):
        return "hidden"
    for parts in _class_names(own):
        kinds = [_NAMES[x] for x in parts if x in _NAMES]
        if not kinds or parts[0] in _OPPOSITE:
            continue
        if tag in ("article", "main") and (kinds[0] not in ("comments", "advert") or parts[0] not in _NAMES):
            continue
        return kinds[0]
    if tag not in ("article", "main") and grade < 2 and any(x[:1] == ["header"] or x[-1:] == ["header"] for x in _class_names(own)):
        return "header"
    return None


def _tag_end(page: str, at: int) -> int:
    """Where the tag that begins at ends: the first > outside of quotes, or the first one if its quotes do not close."""
    end = page.find(">", at)
    inside = page[at:end]
    if '"' not in inside and "'" not in inside:
        return end
    i, n = at, min(len(page), at + 65_536)
    quote = ""
    while i < n:
        c = page[i]
        if quote:
            quote = "" if c == quote else quote
        elif c == ">":
            return i
        elif c in "\"'" and page[i - 1] in "= \t\r\n":
            quote = c
        i += 1
    return end


def blocks(page: str) -> list[Block]:
    """The blocks of a page in its order."""
    out = _Reader()
    at, last = 0, page.rfind(">")
    while True:
        tag = page.find("<", at)
        if tag < 0 or tag > last:
            out.text(page[at:])
            break
        if page.startswith("<!--", tag):
            out.text(page[at:tag])
            end = tag + 4 if page.startswith(">", tag + 4) else page.find("-->", tag + 2)
            if end < 0:
                break
            at = end + (1 if end == tag + 4 else 3)
            continue
        if page[tag + 1 : tag + 2] in ("!", "?"):
            out.text(page[at:tag])
            at = page.find(">", tag) + 1
            continue
        name = _NAME.match(page, tag + 1)
        if not name:
            out.text(page[at : tag + 1])
            at = tag + 1
            continue
        out.text(page[at:tag])
        what, end = name[1].lower(), _tag_end(page, name.end())
        at = end + 1
        closing, own = page[tag + 1] == "/", page[name.end() : end]
        if what == "br":
            out.text(" ")
        elif what in _RAW and not closing:
            if not own.rstrip().endswith("/") or what in ("script", "style", "title", "head", "textarea"):
                out.cut()
                found = re.compile(rf"</{what}(?=[\s/>])|<body(?=[\s>])" if what == "head" else rf"</{what}(?=[\s/>])", re.I).search(page, at)
                if found is None and what != "head":
                    break
                if found:
                    at = found.start() if found[0].lower() == "<body" else page.find(">", found.end()) + 1 or len(page)
        elif what in _VOID:
            if what == "hr":
                out.cut()
            elif what in ("img", "input"):
                out.text(" ")
        else:
            if what in _BLOCKS:
                out.cut()
            if closing:
                if what not in _BLOCKS and out.end_inline(what):
                    continue
                out.close(what)
            else:
                out.start(what, own)
    out.cut()
    return out.blocks


def first_pass(found: list[Block]) -> None:
    """Labels by what encloses a block, link density, length and stop-word density."""
    for b in found:
        n, linked = len(b.text), b.linked / len(b.text)
        words = _WORD.findall(b.text.lower())
        stopped = sum(w in STOP_WORDS for w in words) / len(words) if words else 0
        fluent = n >= SHORT and stopped >= STOPPED
        if b.said or linked > (ALL_LINKED if b.grade == 3 else LINKED) and not (b.grade == 3 and fluent):
            b.label = "bad"
            continue
        if b.grade == 3 and linked > LINKED and not fluent:
            continue
        if b.grade < 2 and n < LONG and ("©" in b.text or "copyright" in b.text.lower()):
            b.label = "bad"
        elif n >= SHORT and (b.grade == 3 or fluent or (n >= LONG and stopped >= FEW_STOPPED)):
            b.label = "good"


def second_pass(found: list[Block]) -> None:
    """Open blocks take the label of the nearest decided block of their container that no enclosing element has decided."""
    groups: dict[int, list[Block]] = {}
    for b in found:
        if not b.said:
            groups.setdefault(b.container, []).append(b)
    for own in groups.values():
        labels = [b.label for b in own]
        before, near = None, []
        for i, label in enumerate(labels):
            before = i if label != "open" else before
            near.append(before)
        after = None
        for i in range(len(own) - 1, -1, -1):
            after = i if labels[i] != "open" else after
            if labels[i] == "open":
                sides = [(abs(i - j), labels[j] == "bad") for j in (near[i], after) if j is not None]
                own[i].label = "bad" if sides and min(sides)[1] else "good"


def main_text(page: str) -> str:
    found = blocks(page)
    first_pass(found)
    second_pass(found)
    kept = [b for b in found if b.label == "good"]
    for grade in (1, 2, 3):
        best = sum(len(b.text) for b in kept if b.grade >= grade)
        if best and 2 * best >= sum(len(b.text) for b in kept if b.grade < grade):
            kept = [b for b in kept if b.grade >= grade]
    return " ".join(b.text for b in kept)


def extract(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""
    pages = df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for small in (batch.slice(i, _BATCH) for i in range(0, batch.num_rows, _BATCH)):
                rows = [(page_id, url, text := main_text(page), len(text)) for page_id, url, page in arrow_rows(small)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op13_html_extraction": op13_html_extraction}
ORACLE_SQL: dict[str, str] = {}
