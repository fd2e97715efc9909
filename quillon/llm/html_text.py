"""Main text of web pages by line-block distribution.

A page is laid out as lines, one a block element. Markup goes, and with it the elements that are boilerplate by their tag, role,
class or id (navigation, header, footer, sidebar, notice, advert, form, comments). A class or id says so only as a whole token, or one
put together from such words and words of place; an element that holds most of the page's text is none, whatever it is called, unless
it holds the readers' comments and something else is left. Inside of an article a header keeps its headings.

What says nothing is judged by the distribution of text. A line's length is its characters outside links, or zero if most are in
links; on a page with <article> or <main> elements zero outside them, and on any other page zero for a weak line: one without a
sentence's end, in no element of prose, and below half of the length in which half of the page's text stands. The lengths are
summed over a sliding window of lines. The text starts at a surge, a line with a length where the sum rises from nothing, and ends at a
dive, where the sum falls back to nothing; all lines between are kept. So a menu of short lines, or a list of links as long as the
window, goes, and a line of links between paragraphs stays.

A null or empty page, and one without any main text, gives the empty string. Repeated rows are separate pages. Other columns
are not read. End tags that HTML lets one leave out are implied; truncated markup is read as far as it goes; <body> ends a head that was
not closed. The work is linear in the page.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Never text, and boilerplate unless most of the page's text is in it.
NO_TEXT = frozenset("head script style noscript template svg canvas iframe object button select textarea option menu".split())
DROPPED = frozenset("nav header footer aside form dialog".split())
#: Words of class, id and role that mark boilerplate, alone or with words of place; those of readers' comments.
COMMENTS = frozenset("comment comments reply replies disqus respond".split())
MARKS = COMMENTS | frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside breadcrumb breadcrumbs cookie cookies consent notice notices banner ad ads advert adverts advertisement promo sponsor sponsored "
    "share sharing social related recommended newsletter subscribe signup login search popup modal toolbar pagination pager widget complementary contentinfo".split()
)
PLACES = frozenset("site page main top bottom left right global primary secondary sub mobile desktop sticky fixed wrapper wrap container box bar block inner outer area section region list links link icons icon buttons items item thread form unit slot".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PROSE = HEADINGS | frozenset(("p", "pre", "blockquote", "dd", "figcaption"))
MAIN = frozenset(("article", "main"))
#: What ends with the start of another element (the innermost block, or one found through the blocks named last).
ENDS_P = HEADINGS | frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form header hr main menu nav ol p pre section table ul".split())
IMPLIED = {
    "li": (("li",), ("p", "div", "address")), "dt": (("dt", "dd"), ("p", "div", "address")), "dd": (("dt", "dd"), ("p", "div", "address")), "option": (("option",), ()), "td": (("td", "th"), ("p", "div")), "th": (("td", "th"), ("p", "div")),
    "tr": (("tr",), ("td", "th", "p", "div")), "tbody": (("tbody", "thead", "tfoot"), ("tr", "td", "th", "p")), "tfoot": (("tbody", "thead"), ("tr", "td", "th", "p")),
}
PARTS = re.compile(r"[-_]+")
SENTENCE = re.compile(r"[.!?:;…。！？][\"'”’»)\]]*$")
RIGHTS = re.compile(r"^(©|\(c\)|copyright\b)|all rights reserved", re.IGNORECASE)


def marked(attrs: list[tuple[str, str | None]]) -> frozenset[str]:
    """The words of boilerplate that an element's class, id and role say."""
    found: set[str] = set()
    for name, value in attrs:
        if value and name in ("class", "id", "role"):
            for token in value.lower().split():
                parts = [w for w in PARTS.split(token) if w and not w.isdigit()]
                if all(w in MARKS or w in PLACES for w in parts):
                    found.update(w for w in parts if w in MARKS)
    return frozenset(found)


class Lines(HTMLParser):
    """Collects the pieces of every line: text, in a link, in a main element, in prose, the innermost marked element about it (-1: none), in a heading."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list[tuple[str, bool, bool, bool, int, bool]]] = []
        self.parts: list[tuple[str, bool, bool, bool, int, bool]] = []
        self.open: list[list] = []  # [element, number of its mark or None]; an element that ended below others is [None, None]
        self.blocks: list[int] = []  # places in ``open`` of what is not inline
        self.places: dict[str, list[int]] = defaultdict(list)
        self.marks: dict[int, None] = {}  # marked elements that are open, in order
        self.about: list[int] = []  # by number of a mark, the mark about it
        self.comments: list[bool] = []  # whether it is of readers' comments
        self.headers: list[bool] = []  # whether it is a header inside of a main element
        self.counts: Counter[str] = Counter()  # open elements by name, and by group

    def end_line(self) -> None:
        if self.parts:
            self.lines.append(self.parts)
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.end_line()
        if tag == "body" and self.counts["head"]:
            self.handle_endtag("head")
        if tag in ENDS_P and self.blocks and self.open[self.blocks[-1]][0] == "p":
            self.pop_to(self.blocks[-1])
        if tag in IMPLIED:
            names, through = IMPLIED[tag]
            at = next((b for b in reversed(self.blocks) if self.open[b][0] not in through), None) if self.counts[names[0]] or self.counts[names[-1]] else None
            if at is not None and self.open[at][0] in names:
                self.pop_to(at)
        if tag == "a" and self.places["a"]:
            self.handle_endtag("a")
        if tag == "br":
            self.parts.append((" ", False, False, False, -1, False))
        if tag in VOID:
            return
        words = marked(attrs) if attrs else frozenset()
        main = self.counts["main element"] > 0
        header = main and tag not in MAIN and (tag == "header" or words == {"header"})
        mark = None
        if header or (tag not in ("html", "body") and (words or tag in DROPPED or any(k == "hidden" for k, _ in attrs))):
            mark = len(self.about)
            self.about.append(next(reversed(self.marks), -1))
            self.comments.append(bool(words & COMMENTS))
            self.headers.append(header)
            self.marks[mark] = None
        self.places[tag].append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append([tag, mark])
        self.count(tag, mark, 1)

    def count(self, tag: str, mark: int | None, by: int) -> None:
        self.counts[tag] += by
        for name, group in (("no text", NO_TEXT), ("heading", HEADINGS), ("prose", PROSE)):
            self.counts[name] += by * (tag in group)
        self.counts["main element"] += by * (tag in MAIN and mark is None)

    def end(self, at: int) -> None:
        tag, mark = self.open[at]
        if tag is not None:
            self.places[tag].pop()
            self.count(tag, mark, -1)
            if mark is not None:
                del self.marks[mark]

    def pop_to(self, at: int) -> None:
        while len(self.open) > at:
            self.end(len(self.open) - 1)
            self.open.pop()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        if not self.places[tag]:
            return
        at = self.places[tag][-1]
        if tag in INLINE and self.blocks and self.blocks[-1] > at:  # an inline element does not end the blocks begun in it
            self.end(at)
            self.open[at] = [None, None]
        else:
            self.pop_to(at)

    def handle_data(self, data: str) -> None:
        if not self.counts["no text"]:
            self.parts.append((data, self.counts["a"] > 0, self.counts["main element"] > 0, self.counts["prose"] > 0, next(reversed(self.marks), -1), self.counts["heading"] > 0))


def stretches(lengths: list[int], window: int) -> list[tuple[int, int, int]]:
    """(surge, dive, peak): from a line with a length, where the sum over ``window`` lines from it on rises from nothing, to where it is nothing again."""
    found, start, peak = [], None, 0
    total = sum(lengths[: window - 1])
    for i in range(len(lengths) + 1):
        total += lengths[i + window - 1] if i + window - 1 < len(lengths) else 0
        if start is None and total and lengths[i]:
            start, peak = i, 0
        if start is not None:
            peak = max(peak, total)
            if not total:
                found.append((start, i, peak))
                start = None
        total -= lengths[i] if i < len(lengths) else 0
    return found


def boilerplate(page: Lines) -> tuple[list[bool], list[bool]]:
    """By number of a mark, whether text in it goes, and whether a heading does, which headers inside of main elements keep.

    Of the marked elements those count that hold at most half of the page's text outside links, and those of comments where something
    else is left.
    """
    many = len(page.about)
    of_comments = list(page.comments)
    for m in range(many):
        of_comments[m] |= page.about[m] >= 0 and of_comments[page.about[m]]
    within = [0] * (many + 1)
    apart = 0
    for line in page.lines:
        for text, link, _, _, mark, _ in line:
            if not link:
                within[mark] += (size := len(text.strip()))
                apart += size * (mark < 0 or not of_comments[mark])
    for m in reversed(range(many)):  # the last of the list is what no mark is about
        within[page.about[m]] += within[m]
    text, heading = [False] * many, [False] * many
    for m in range(many):
        counts = apart > 0 if page.comments[m] else 2 * within[m] <= within[-1]
        text[m] = counts or (page.about[m] >= 0 and text[page.about[m]])
        heading[m] = (counts and not page.headers[m]) or (page.about[m] >= 0 and heading[page.about[m]])
    return text, heading


def main_text(html: str | None, window: int = 3) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.end_line()
    gone, without = boilerplate(page)
    lines: list[tuple[str, int, bool, bool]] = []  # text, characters in links, in a main element, in prose
    for parts in page.lines:
        kept = [x for x in parts if x[4] < 0 or not (without if x[5] else gone)[x[4]]]
        if text := " ".join("".join(x[0] for x in kept).split()):
            lines.append((text, sum(len(x[0].strip()) for x in kept if x[1]), any(x[2] for x in kept), any(x[3] for x in kept)))
    inside = any(main for _, _, main, _ in lines)
    own = [0 if 2 * links > len(text) else len(text) - links for text, links, _, _ in lines]
    if inside:
        lengths = [n if main else 0 for n, (_, _, main, _) in zip(own, lines, strict=True)]
    else:
        rest = total = sum(own)
        half = 0
        for n in sorted(own, reverse=True):  # half of the text stands in lines at least so long
            rest -= n
            half = n
            if 2 * rest <= total:
                break
        weak = lambda n, line: bool(RIGHTS.search(line[0])) or (2 * n < half and not line[3] and not SENTENCE.search(line[0]))
        lengths = [0 if weak(n, line) else n for n, line in zip(own, lines, strict=True)]
    return "\n\n".join(lines[i][0] for surge, dive, _ in stretches(lengths, window) for i in range(surge, dive) if lines[i][2] or not inside)


def extract(pages: DataFrame, window: int = 3) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), window) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


#: The same for pages of the test tables' form, in DuckDB SQL: one article, blocks cut at p and h1 elements, few references.
ORACLE = r"""
  with a as (select page_id, url, regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1) as t from pages),
  b as (select page_id, url, list_filter(list_transform(string_split_regex(t, '</?(p|h1)>'),
          lambda x: trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'),
               '&quot;', '"'), '&lt;', '<'), '&amp;', '&'), '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') as blocks from a)
  select page_id, url, array_to_string(blocks, chr(10) || chr(10)) as text,
         cast(length(array_to_string(blocks, chr(10) || chr(10))) as bigint) as n_chars from b"""
