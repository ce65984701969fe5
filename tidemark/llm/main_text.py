"""Main text of web pages: parser events, text-to-tag ratios per line, smoothing, threshold clustering.

The standard library's parser turns a page into events. Events are cut into lines: a line is the text of one block (a
paragraph, heading, list item, cell, ...), with the number of tags and of linked characters in it. A page then goes
through three steps:

1. Lines inside elements that are boilerplate by their meaning (scripts, styles, menus, headers, footers, asides, forms,
   hidden elements) are set aside, and so are elements, articles too, whose class, id or role names an advert, notice, comment
   section, share bar, ... A name is evidence weighed against the text: an element that holds more than half of the page's unlinked
   text stays, where text outside it counts ``MARK`` times if an article or main element without such a name marks it. Readers'
   comments are judged first, stay only with more than ``READERS`` of the text, and else don't count for other names. Modifiers
   (``with-sidebar``, ``overflow-hidden``, ``share-enabled``) name nothing. ``header`` inside an article is the article's own.
2. Every other line has a ratio: unlinked characters per tag, capped at the page's typical ratio M, at which half of its text
   lies, so that one long paragraph does not outshine the rest. Ratios are smoothed by a Gaussian over neighbouring lines,
   and lines whose own or smoothed ratio reaches the threshold M/2 are content, the others rest. If the page marks an ``article``
   or ``main`` element, lines inside have a bonus of M/2 after smoothing, so that its short lines stay; lines outside are
   still chosen by their ratio, in runs of ``RUN`` unlinked characters or half of the marked text at least. A heading goes with the line after it, on the same side of the mark.
   A line outside that is mostly links is rest.
3. Content lines, in page order, joined by one line break.

Character references are decoded once, white space inside a block is one space, blocks are trimmed and empty ones left out.
Nothing is capped: a page of any length is parsed in pieces, and a block is kept whole.

Edge cases: NULL or empty pages have the empty text; unclosed, crossed and stray tags end where their block ends; a page cut
off inside a tag or reference keeps what came before; a page without tags is its text; other columns are ignored by the
query and kept by ``extracted``.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import small_batches

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead"
    " tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head script style template noscript iframe object svg math canvas audio video nav header footer aside form button"
    " select textarea label fieldset menu dialog title".split()
)
#: Words of a class, id or role that name what is not the article.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adslot|sponsor(?:ed)?|promo(?:ted|tion)?|banner|nav|navbar|navigation"
    r"|menu|breadcrumbs?|sidebar|side|header|masthead|footer|foot|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay"
    r"|newsletter|subscri(?:be|ption)|signup|login|comments?|commentlist|disqus|replies|respond|share|sharing|social|related"
    r"|recommend(?:ed|ations)?|widget|pagination|pager|search|form|toolbar|copyright|legal|disclaimer|contentinfo|complementary"
    r"|alertdialog|skip|hidden|toc|tags)(?:$|[\s_-]|\d)",
    re.I,
)
#: Those of them that name what readers wrote, and names that only say how an element is laid out.
READER = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond)(?:$|[\s_-]|\d)", re.I)
MODIFIER = re.compile(r"(?:with|without|no|not|non|has|overflow)[_-]|.*[_-](?:enabled|disabled|open|closed|on|off|layout)$", re.I)
#: An opening tag of one of these ends an open element of the others (their end tags may be left out).
ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPE = frozenset("article aside body div footer form header html main nav ol section table ul".split())
SIGMA, MOST_LINKED = 1.0, 0.5
MARK, READERS = 4, 0.9
RUN = 100  # unlinked characters of a run of lines outside a page's mark, where half of the marked text is not less
PIECE = 1 << 20
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    inside: bool
    heading: bool

    @property
    def links_only(self) -> bool:
        return self.linked > MOST_LINKED * len(self.text)


class Open(NamedTuple):
    """An open element."""

    name: str
    dropped: bool
    inside: bool  # of an article or main element
    weight: int  # of its text against names
    named: int  # the innermost element with a name of boilerplate, 0 for none


class Lines(HTMLParser):
    """Lines of a page with their tag counts, from a stream of parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.raw: list[tuple[list[tuple[str, int, int]], int, bool, bool]] = []  # parts, tags, inside, heading
        self.parts: list[tuple[str, int, int]] = []  # data, named, linked characters
        self.tags, self.links = 0, 0
        # Per named element: the one around it, whether readers wrote it, its own unlinked text, plain and weighted.
        self.around, self.reader, self.plain, self.heavy = [0], [False], [0], [0]

    def end_line(self) -> None:
        if any(data and not data.isspace() for data, _, _ in self.parts):
            inside = bool(self.open and self.open[-1].inside)
            heading = any(x.name in HEADINGS for x in self.open)
            self.raw.append((self.parts, self.tags, inside, heading))
            self.tags = 0
        self.parts = []

    def lines(self) -> list[Line]:
        """The lines without boilerplate; tags before a line that is left out count for the next."""
        gone, out, before = self.gone(), [], 0
        for parts, tags, inside, heading in self.raw:
            left = [x for x in parts if not gone[x[1]]]
            text = " ".join("".join(x[0] for x in left).split())
            before += tags
            if text:
                out.append(Line(text, before, sum(x[2] for x in left), inside, heading))
                before = 0
        return out

    def gone(self) -> list[bool]:
        """Which named elements are boilerplate."""
        n = len(self.around)
        gone, written = [False] * n, [False] * n
        for i in range(1, n):
            written[i] = self.reader[i] or written[self.around[i]]
        plain, heavy = self.sums(self.plain, [False] * n), self.sums(self.heavy, written)
        for i in range(1, n):
            up = self.around[i]
            if self.reader[i] and not written[up]:
                gone[i] = plain[i] <= READERS * (plain[i] + heavy[0] - heavy[i])
            else:
                gone[i] = gone[up]
        plain, heavy = self.sums(self.plain, gone), self.sums(self.heavy, gone)
        for i in range(1, n):
            gone[i] = gone[i] or gone[self.around[i]]
            if not gone[i] and not self.reader[i]:
                gone[i] = plain[i] <= 0.5 * (plain[i] + heavy[0] - heavy[i])
        return gone

    def sums(self, own: list[int], left_out: list[bool]) -> list[int]:
        """Text of elements with all named ones in them; an element is opened after the one around it."""
        out = [0 if no else x for x, no in zip(own, left_out)]
        for i in range(len(out) - 1, 0, -1):
            out[self.around[i]] += out[i]
        return out

    def close_to(self, depth: int) -> None:
        for x in self.open[depth:]:
            self.links -= x.name == "a"
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        elif tag == "br":
            self.parts.append((" ", 0, 0))
        if tag in VOID:
            return
        if tag in ENDS or tag in BLOCKS:
            self.imply_ends(tag)
        _, dropped, inside, weight, named = self.open[-1] if self.open else Open("", False, False, 1, 0)
        if not dropped:
            given = {k: v or "" for k, v in attrs}
            own = tag == "header" and inside
            frame = tag in ("body", "html")
            dropped = (tag in DROPPED and not own) or (not frame and self.hidden(given))
            names = [] if dropped or own or frame else self.names(given)
            if names:
                self.around.append(named)
                self.reader.append(any(map(READER.search, names)))
                self.plain.append(0)
                self.heavy.append(0)
                named = len(self.around) - 1
            if tag in ("article", "main") and not dropped:
                inside, weight = True, weight if names else MARK
        self.open.append(Open(tag, dropped, inside, weight, named))
        self.links += tag == "a"

    @staticmethod
    def hidden(attrs: dict[str, str]) -> bool:
        return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()

    @staticmethod
    def names(attrs: dict[str, str]) -> list[str]:
        """Words of the class, id and role that name boilerplate."""
        words = re.sub(r"([a-z])([A-Z])", r"\1-\2", " ".join(attrs.get(k, "") for k in ("class", "id", "role"))).split()
        return [w for w in words if NAMES.search(w) and not MODIFIER.match(w)]

    def imply_ends(self, tag: str) -> None:
        """End tags that may be left out: a block ends an open paragraph; items end items."""
        ends = ENDS.get(tag, frozenset())
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at].name
            if name in ends or (name == "p" and tag in BLOCKS):
                self.close_to(at)
                return
            if name in SCOPE:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].name == tag:
                self.close_to(at)
                return
            if self.open[at].name in SCOPE and tag not in SCOPE:
                return

    def handle_data(self, data: str) -> None:
        _, dropped, _, weight, named = self.open[-1] if self.open else Open("", False, False, 1, 0)
        if dropped:
            return
        n = len(data.strip())
        self.parts.append((data, named, n if self.links else 0))
        if not self.links:
            self.plain[named] += n
            self.heavy[named] += weight * n


def lines_of(html: str) -> list[Line]:
    parser = Lines()
    for at in range(0, len(html), PIECE):
        parser.feed(html[at : at + PIECE])
    if re.match(r"<[a-zA-Z/!?]", parser.rawdata):  # the page ends inside a tag
        parser.rawdata = ""
    parser.close()
    parser.end_line()
    return parser.lines()


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, the ends repeated."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def typical(ratio: np.ndarray, weight: np.ndarray) -> float:
    """The ratio at or below which half of the weight lies."""
    order = np.argsort(ratio, kind="stable")
    return float(ratio[order][np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)])


def chosen(lines: list[Line]) -> list[bool]:
    """Which lines are content."""
    free = np.array([0 if x.links_only else len(x.text) - x.linked for x in lines], float)
    ratio = np.maximum(free, 0) / np.array([max(x.tags, 1) for x in lines])
    level = typical(ratio, np.maximum(free, 1e-9)) or 1.0
    ratio = np.minimum(ratio, level)
    bonus = np.where([x.inside for x in lines], level / 2, 0.0)
    score = np.maximum(smoothed(ratio), ratio) + bonus
    kept = [bool(v >= level / 2) and (x.inside or not x.links_only) for v, x in zip(score, lines)]
    for at in range(len(lines) - 2, -1, -1):
        if lines[at].heading and lines[at].inside == lines[at + 1].inside and not lines[at].links_only:
            kept[at] = kept[at] or kept[at + 1]
    if not bonus.any():
        return kept
    # A stray line beside the mark, however dense, is no text of its own.
    run = np.array(kept) & (bonus == 0)
    edges = np.flatnonzero(np.diff(run.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    for first, last in edges:
        if free[first:last].sum() < min(RUN, free[bonus > 0].sum() / 2):
            kept[first:last] = [False] * (last - first)
    return kept


def content(html: str) -> str:
    """The main text of a page."""
    lines = lines_of(html)
    return "\n".join(x.text for x, keep in zip(lines, chosen(lines)) if keep) if lines else ""


def extracted(pages: DataFrame, html: str = "html", into: str = "main_text") -> DataFrame:
    """``pages`` with the main text; one pass over the rows, no shuffle."""

    small_batches(pages.sparkSession)
    @F.pandas_udf("string")
    def text(column):
        return column.map(lambda h: content(h) if h else "")

    return pages.withColumn(into, text(F.coalesce(F.col(html), F.lit(""))))


def op2_text_ratio(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


QUERIES = {"op2_text_ratio": op2_text_ratio}
