"""Main text of web pages by the distribution of text over lines.

Markup is stripped into lines, one for each block element. A line counts with the length of its text outside links (in a
heading, of all its text). Over these lengths a window of ``WINDOW`` lines is slid: the text begins where the sum of the
window that begins there surges above a threshold, and ends where it dives below it; every such stretch is text, and what
stands outside, such as runs of links or lone words, is not. The threshold comes from the page's own line lengths: ``RISE`` of
the length of a line as a character of the page sees it, and nothing at all in a marked article, of which no text is lost. At
a surge, lines of less than a window's share of the threshold are passed over up to the first longer one or heading; links
alone don't begin or end a stretch.

Kinds of elements (navigation, forms ...), words of a class, id or role (adverts, notices ...) and standing outside of the
page's article element are hints only: each makes a line's text weigh ``HINT`` of what it would. The hint under which most
weight stands is the text's own: lines hinted at more are left out of the sums and of the text, as a form or an ill-named box
around everything hints at all lines alike. An element ends where HTML says so, also where its end tag is left out.

Null or empty html gives an empty text, as does a page without any text; unclosed or stray tags and quotes and an unclosed
comment don't raise, and cost no more than other text; where all text is in links, they count; repeated rows stay; only
page_id, url and html are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spread

WINDOW, RISE, HINT = 3, 0.05, 0.03

# Names of HTML elements.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas")
ARTICLE = {"article", "main"}
NO_TEXT = {"head", "nav", "footer", "aside", "form", "select", "button", "menu", "dialog", "audio", "video", "map", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
# Where end tags may be left out, what start tags close, and what they and end tags don't reach beyond.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
IN_HEAD = {"html", "head", "base", "link", "meta", *RAW}
CELLS = {"table", "td", "th", "caption"}
ENDS_P = HEADINGS | set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre search section summary table ul".split())
ROWS = {"thead", "tbody", "tfoot"}
SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
IN_TABLE = {"td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr", "caption"}, {"table"}), **dict.fromkeys(ROWS, (ROWS | {"tr", "caption"}, {"table"}))}
# Words in a class, id or role that mark boilerplate.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo(?:tion)?|nav(?:igation|bar)?|menu|breadcrumbs?|footer|sidebar|side|"
    r"comments?|respond|replies|disqus|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|"
    r"masthead|site-header|page-header|topbar|toolbar|search|widget|pagination|pager|copyright|legal|disclaimer|complementary|contentinfo|alert|skip-link)(?:$|[\s_-])",
    re.I,
)
# Every repetition is possessive, so that no malformed tag makes the search go back; one with a stray quote ends at its first >.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(RAW)})\b(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+>.*?(?:</(?P=raw)\s*+>|\Z)|<[!?][^<>]*+>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<rest>(?:\"[^\"<]*+\"|'[^'<]*+'|[^>\"'<]|[\"'])*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][\w:-]*+)(?P<rest2>[^<>]*+)>",
    re.S | re.I,
)
MARKS = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden(?:\s|$|=)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


class Open:
    """The elements open at a place, outermost first."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.hints: list[int] = []  # how many each stands in, itself included
        self.n: Counter[str] = Counter()

    def push(self, tag: str, hinted: bool) -> None:
        self.hints.append(self.hint() + hinted)
        self.tags.append(tag)
        self.n[tag] += 1

    def hint(self) -> int:
        return self.hints[-1] if self.hints else 0

    def inside(self, which: set[str]) -> bool:
        return any(self.n[t] > 0 for t in which)

    def _cut(self, at: int) -> None:
        self.n.subtract(self.tags[at:])
        del self.tags[at:], self.hints[at:]

    def _find(self, which: set[str], stops) -> int:
        """The place of the innermost open element of these, or -1 if there is none before one that stops the search."""
        if any(self.n[t] > 0 for t in which):
            for at in range(len(self.tags) - 1, -1, -1):
                if self.tags[at] in which:
                    return at
                if stops(self.tags[at]):
                    break
        return -1

    def start(self, tag: str) -> None:
        """Ends what a start tag ends."""
        at = -1
        if tag not in IN_HEAD and self.n["head"]:
            at = self._find({"head"}, lambda t: False)
        elif tag in IN_TABLE:
            which, stops = IN_TABLE[tag]
            at = self._find(which, stops.__contains__)
            if tag in ROWS:
                while at >= 0 and (more := self._find_before(at, which)) >= 0:
                    at = more
        elif tag in SAME_KIND:
            at = self._find(SAME_KIND[tag], lambda t: t not in INLINE and t not in ("address", "div", "p"))
        if at >= 0:
            self._cut(at)
        if tag in ENDS_P or tag in SAME_KIND:
            at = self._find({"p"}, lambda t: t in CELLS or t == "button")
            if at >= 0:
                self._cut(at)

    def _find_before(self, at: int, which: set[str]) -> int:
        for k in range(at - 1, -1, -1):
            if self.tags[k] in which:
                return k
            if self.tags[k] == "table":
                break
        return -1

    def end(self, tag: str) -> int:
        """Ends what an end tag ends; the place of its element, or -1 if it has none."""
        if tag in INLINE:
            at = self._find({tag}, lambda t: t not in INLINE and t != "p")
        elif tag in ("table", "caption") or tag in IN_TABLE:
            at = self._find({tag}, lambda t: t == "table")
        elif tag in ("body", "html"):
            at = self._find({tag}, lambda t: False)
        else:
            at = self._find(HEADINGS if tag in HEADINGS else {tag}, lambda t: t in CELLS or tag == "li" and t in ("ul", "ol") or tag == "p" and t == "button")
        if at >= 0:
            self._cut(at)
        return at


class Line(NamedTuple):
    text: str
    plain: int  # length of what is in no link, or in a heading
    hints: int
    inside: bool  # of an article or main element
    heading: bool


def lines(page: str) -> list[Line]:
    """The blocks that hold text, in page order."""
    out: list[Line] = []
    part: list[str] = []
    plain: list[str] = []
    opened = Open()
    own_hint = 0  # of the line at hand: text under another number of hints is another line

    def spelled(parts: list[str]) -> str:
        return " ".join(html.unescape("".join(parts)).split())

    def add(text: str) -> None:
        nonlocal own_hint
        if opened.hint() != own_hint:
            end_line()
            own_hint = opened.hint()
        part.append(text)
        plain.append(" " if opened.n["a"] > 0 and not opened.inside(HEADINGS) else text)

    def end_line() -> None:
        text = spelled(part)
        if text:
            heading = opened.inside(HEADINGS)
            out.append(Line(text, len(text) if plain == part else len(spelled(plain)), own_hint, opened.inside(ARTICLE), heading))
        part.clear()
        plain.clear()

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["raw"] is not None:
                add(" ")
            continue
        tag, close, rest = tag.lower(), m["close"] or m["close2"], m["rest"] or m["rest2"] or ""
        if tag == "br":
            add(" ")
        elif tag not in INLINE:
            end_line()
        if close:
            opened.end(tag)
            continue
        opened.start(tag)
        if tag in VOID or rest.endswith("/") and tag not in NO_TEXT or tag == "a" and "href" not in rest.lower():
            continue
        in_article = opened.inside(ARTICLE)
        opened.push(tag, tag in NO_TEXT or tag == "header" and not in_article or bool(rest) and tag not in ("html", "body") and marked(rest))
    if at < len(page):
        add(page[at:])
    end_line()
    return out


def marked(rest: str) -> bool:
    return any(BOILERPLATE.search(x) for m in MARKS.finditer(rest) for x in m.groups() if x) or bool(HIDDEN.search(rest))


def main_lines(all_lines: list[Line]) -> list[int]:
    """Which lines are the main text."""
    if not all_lines:
        return []
    length = np.array([x.plain for x in all_lines], np.float64)
    if not length.any():
        length = np.array([len(x.text) for x in all_lines], np.float64)
    inside = np.array([x.inside for x in all_lines])
    hints = np.array([x.hints for x in all_lines])
    if inside.any():
        hints = hints + ~inside
    mass = np.bincount(hints, length) * HINT ** np.arange(hints.max() + 1)
    own = hints <= mass.argmax()
    weight = np.where(own, length, 0)
    if not weight.any():
        return []
    article = bool((own & inside & (weight > 0)).any())
    threshold = 0.0 if article else RISE * (weight**2).sum() / weight.sum()
    total = np.concatenate([[0], np.cumsum(weight), np.full(WINDOW, weight.sum())])
    sums = total[WINDOW : WINDOW + len(weight)] - total[: len(weight)]
    edge = np.diff((sums > threshold).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    out: list[int] = []
    for surge, dive in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        while surge < dive and not (weight[surge] > threshold / WINDOW or weight[surge] and all_lines[surge].heading):
            surge += 1
        while surge < dive and not weight[dive - 1]:
            dive -= 1
        out += [k for k in range(surge, dive) if own[k]]
    return out


def main_text(page: str | None) -> str:
    all_lines = lines(page or "")
    return "\n".join(all_lines[k].text for k in main_lines(all_lines))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row."""
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batch: pa.RecordBatch) -> pa.Table:
        return pa.table({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(map(main_text, batch.column(2).to_pylist()), pa.string())})

    out = map_arrow(spread(pages.select("page_id", "url", "html")), run, f"{kinds}, text string", 500)
    return out.withColumn("n_chars", F.length("text").cast("long"))
