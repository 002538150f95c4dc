"""Main text of HTML pages: streaming parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clusters.

The standard library's parser feeds lines: a line is the text between two block boundaries, with the number of tags met in
it. The text-to-tag ratios of the lines are smoothed by a Gaussian; runs of lines above the threshold, a share of the ratios'
standard deviation, are the content clusters, and where their text lies tells the content:

- with article elements, those that hold half as much of it as the one that holds most, and together most of the main element's
  or the page's; else the main element, if it holds most of it;
- else the innermost element with four fifths of it, or, where that is the body, the span from the first cluster to the last.

All lines of that part are content, with the headings right before it, but those marked as something else and runs of links with
little more, of which less than half are in clusters. Lines are marked by elements and roles that never hold an article (menus, headers,
footers, asides, forms, hidden parts; headings in an article's header are its own), and by class, id and label, see ``grade``.
Class words that are only part of a name, or may be a topic, do not count if more than half of the clusters' text had them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .words import slices

# Element names and words in class, id or role that mark parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics annotation annotation-xml".split())
RAW = frozenset("script style noscript template iframe object svg canvas button select textarea datalist option head title audio video map applet".split())
PARTS_OF_PAGE = frozenset("nav header footer aside form dialog menu fieldset label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
REGIONS = frozenset(["article", "main"])
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"menu|nav|navbar|navigation|breadcrumbs?|sidebar|side|widget\w*|related|recommend\w*|share|sharing|social|comments?|commentlist|respond|replies|disqus|"
    r"footer|foot|header|masthead|toolbar|pagination|pager|copyright|legal|disclaimer|skip|search|tags|byline-share)(?:$|[\s_-])",
    re.I,
)
#: Words beside the ones above in names of page parts.
BESIDE = frozenset("site page main top bottom box bar list links posts articles section block area form button buttons icon icons slot unit item items text message primary secondary global and of the us our your".split())
#: Words that mark a class whatever stands beside them; the others may be topics.
STRONG = re.compile(r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|gdpr|newsletter|subscribe|disqus|comments|commentlist|breadcrumbs?|pagination|pager|navbar|masthead|share|sharing", re.I)
#: Names that a class of several names may have for its topic.
TOPICS = re.compile(r"legal|social|related|search|tags|share|sharing|side|notices?|alert|consent|banner|overlay|modal|skip|promo\w*|menu|header|foot|copyright|disclaimer|recommend\w*|replies|respond|subscribe|signup|login", re.I)
#: Ids and labels that mark a section inside an article; the others may be what the section is about.
PARTS = re.compile(r"ads?|adsense|comments?|commentlist|respond|replies|disqus|newsletter|subscribe|signup|sidebar|breadcrumbs?|pagination|pager|navbar|toolbar|masthead", re.I)
LAYOUT = re.compile(r"(?:has|with|without|no|is)[-_]", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
SPACE = re.compile(r"[ \t\n\r\f\v  -   　]+")
PIECE = 2 << 20


def words_in(value: str) -> list[str]:
    return [w for w in re.split(r"[\s_-]+", value) if w]


def whole(one: str) -> bool:
    """Whether all words of a name are names of page parts, words beside included."""
    words = words_in(one)
    return bool(BOILER.fullmatch(one)) or any(BOILER.fullmatch(w) for w in words) and all(BOILER.fullmatch(w) or w.lower() in BESIDE or w.isdigit() for w in words)


def grade(tag: str, name: str, value: str, inside: bool) -> int:
    """2: the element is marked; 1: marked, but for what the page's clusters may say; 0: not marked.

    A name marks if all of its words name page parts. Of a class each name counts; one that may be a topic marks for certain
    only if the others name page parts too. Otherwise words that cannot be topics mark a class; other words mark a class
    outside of articles, and no heading or section. Ids and labels never mark headings, and sections inside an article only
    if they name what is no topic.
    """
    if name != "class" and tag in HEADINGS:
        return 0
    best, names = 0, value.split() if name == "class" else [value]
    for one in names:
        if not BOILER.search(one) or LAYOUT.match(one):
            continue
        words = words_in(one)
        if whole(one):
            if name != "class":
                if not (tag == "section" and inside) or any(PARTS.fullmatch(w) for w in words):
                    best = 2
            else:
                best = max(best, 1 if TOPICS.fullmatch(one) and not all(whole(x) or x.lower() in BESIDE for x in names) else 2)
        elif name == "class" and tag not in HEADINGS and tag != "section" and (not inside or any(STRONG.fullmatch(w) for w in words)):
            best = max(best, 1)
    return best


@dataclass(frozen=True)
class Line:
    """``mark``: 0 none, 1 and 2 as by ``grade``, 3 by element, role or hidden, 4 not text of the page at all. ``path``: numbers
    of the open elements; ``links``: characters inside links."""

    text: str
    tags: int
    links: int
    mark: int
    path: tuple[int, ...]
    heading: bool


class Lines(HTMLParser):
    """Collects lines, and the names of numbered elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # name, mark, number, whether an article's header
        self.marks: list[list[tuple[int, int]]] = []  # of each line: numbers and marks of the open elements
        self.unclosed: set[int] = set()
        self.names: list[str] = []
        self.regions: list[int] = []  # numbers of the open ones
        self.text: list[str] = []
        self.tags = self.links = 0
        self.lines: list[Line] = []

    def end_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            heading = any(e[0] in HEADINGS for e in self.open)
            self.marks.append([(number, mark) for _, mark, number, own in self.open if mark and not (heading and own)])
            self.lines.append(Line(text, self.tags, self.links, 0, tuple(e[2] for e in self.open if e[0] not in INLINE), heading))
            self.tags = self.links = 0
        self.text.clear()

    def done(self) -> list[Line]:
        """All lines, marked. An element that marks a part of the page, but was never closed, marks nothing."""
        self.close()
        self.end_line()
        self.unclosed |= {e[2] for e in self.open}
        lost = {k for k in self.unclosed if self.names[k] in PARTS_OF_PAGE}
        return [replace(x, mark=max((m for k, m in marks if k not in lost), default=0)) for x, marks in zip(self.lines, self.marks, strict=True)]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body" and any(e[0] == "head" for e in self.open):
            self.close_to("head")
        if tag in BLOCK_CLOSES_P and any(e[0] == "p" for e in self.open):
            self.close_to("p")
        elif tag in ("li", "dt", "dd", "option", "tr", "td", "th") and any(e[0] == tag for e in self.open[-3:]):
            self.close_to(tag)
        if tag == "br":
            self.text.append(" ")
        elif tag not in INLINE:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        mark = 4 if tag in RAW else 3 if tag in PARTS_OF_PAGE else 0
        main = tag in REGIONS or any(n == "role" and v == "main" for n, v in attrs)
        for name, value in attrs:
            if name in ("class", "id", "aria-label") and value and (not main or self.regions) and tag not in ("html", "body"):
                mark = max(mark, grade(tag, name, value, bool(self.regions)))
            elif name == "role" and value and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                mark = max(mark, 3)
        number = len(self.names)
        self.names.append("main" if main and tag != "article" else tag)
        if main and not mark:
            if not self.regions:  # what lies around the main part is its layout
                for e in self.open:
                    if e[1] <= (1 if tag == "article" else 2):
                        e[1] = 0
            self.regions.append(number)
        self.open.append([tag, mark, number, tag == "header" and bool(self.regions)])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag and tag in ("svg", "math", "iframe"):
            self.close_to(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if any(e[0] == tag for e in self.open):
            self.close_to(tag)
        elif tag not in INLINE:
            self.end_line()

    def close_to(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        while self.open:
            name, _, number, _ = self.open.pop()
            if number in self.regions:
                self.regions.remove(number)
            if name == tag:
                return
            self.unclosed.add(number)

    def handle_data(self, data: str) -> None:
        if any(e[0] in ("annotation", "annotation-xml") for e in self.open):  # source of a formula, not shown
            return
        self.text.append(data)
        if any(e[0] == "a" for e in self.open):
            self.links += len(data.strip())


def smoothed(ratio: np.ndarray, radius: int = 2) -> np.ndarray:
    """Gaussian smoothing whose weights at the ends are those inside."""
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * max(radius / 2, 0.5) ** 2))
    full = np.convolve(ratio, kernel)[radius : radius + len(ratio)]
    return full / np.convolve(np.ones(len(ratio)), kernel)[radius : radius + len(ratio)]


def clusters(lines: list[Line], share: float) -> np.ndarray:
    """Mask of the lines in content clusters."""
    smooth = smoothed(np.array([len(x.text) / max(x.tags, 1) for x in lines]))
    return smooth >= share * smooth.std()


def usable(lines: list[Line], content: np.ndarray) -> list[int]:
    """Lines that may be content. Doubtful marks do not count if they lie on most of the clusters' text, nor do marks by which
    nothing would be left; those by element, role or hidden do."""
    held = [0] * 5
    for x, inside in zip(lines, content, strict=True):
        held[x.mark] += len(x.text) if inside else 0
    for most in range(1 if held[1] > held[0] else 0, 3):
        if some := [i for i, x in enumerate(lines) if x.mark <= most]:
            return some
    return []


def chosen(lines: list[Line], content: np.ndarray, names: list[str]) -> list[int]:
    """The lines of the part of the page that the clusters' text lies in."""
    weight: dict[int, int] = {}
    total = 0
    for x, inside in zip(lines, content, strict=True):
        if inside:
            total += len(x.text)
            for k in x.path:
                weight[k] = weight.get(k, 0) + len(x.text)
    mains = [k for k in weight if names[k] == "main" and 2 * weight[k] > total]
    base = max(mains, default=None)
    articles = {}
    for x in lines:
        inside = x.path[x.path.index(base) + 1 :] if base in x.path else x.path if base is None else ()
        first = next((k for k in inside if names[k] == "article"), None)
        if first in weight:
            articles[first] = weight[first]
    large = {k for k, w in articles.items() if 2 * w >= max(articles.values())}
    if large and sum(articles[k] for k in large) > 0.6 * (weight[base] if base is not None else total):
        part = large
    elif base is not None:
        part = {base}
    else:
        most = max((k for k, w in weight.items() if 5 * w >= 4 * total), default=None)
        part = {most} if most is not None and names[most] not in ("body", "html") else set()
    if part:
        return [i for i, x in enumerate(lines) if part & set(x.path)]
    picked = np.flatnonzero(content)
    return list(range(int(picked[0]), int(picked[-1]) + 1)) if len(picked) else []


def main_text(html: str | None, *, share: float = 0.5) -> str:
    """Blocks of the article in page order, joined by blank lines."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    every = [x for x in parser.done() if x.mark < 4]
    lines = [every[i] for i in usable(every, clusters(every, share))] if every else []
    if not lines:
        return ""
    content = clusters(lines, share)
    picked = chosen(lines, content, parser.names)
    while picked and picked[0] and lines[picked[0] - 1].heading:
        picked.insert(0, picked[0] - 1)
    return "\n\n".join(lines[i].text for i in without_link_lists(lines, content, picked))


def without_link_lists(lines: list[Line], content: np.ndarray, picked: list[int]) -> list[int]:
    """Runs of lines that are links and little more go unless half of them are in clusters."""
    out, run = [], []
    for i in [*picked, None]:
        if i is not None and not lines[i].heading and 5 * lines[i].links >= 4 * len(lines[i].text):
            run.append(i)
            continue
        if run and 2 * sum(bool(content[k]) for k in run) >= len(run):
            out += run
        run = []
        if i is not None:
            out.append(i)
    return out


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points): one row for each row of ``pages``.

    Null, empty and text-free pages give an empty text. Repeated rows stay, with the same text; null ids and urls stay null; an
    empty table gives no rows; other columns are ignored, whatever their names. A page is worked on as a whole, so its length
    is bounded by a task's memory alone.
    """
    ship(pages.sparkSession)
    picked = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "html", PIECE):
            texts = [main_text(h) for h in piece.column(2).to_pylist()]
            yield pa.record_batch([piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return picked.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
