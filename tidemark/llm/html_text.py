"""Main text of web pages: parser events to lines, text-to-tag ratios, smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that begin and end a line; the others are part of the text around them.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Tags whose content is never part of an article.
OUTSIDE = frozenset("head title script style noscript template nav footer aside button select option textarea input iframe object embed svg canvas menu dialog label legend fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id or role that speak for something else than the article; so does a form.
MARKS = frozenset("""ad ads advert advertisement adverts advertising adsense banner sponsor sponsored promo promotion promoted
    sidebar side nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer bottombar
    cookie cookies consent gdpr notice notification alert popup modal overlay toast
    comment comments commentary respond reply replies disqus discussion
    share sharing social related recommended recommendations newsletter subscribe subscription signup login search form widget pagination pager toolbar skip complementary contentinfo""".split())
#: Words that speak for readers' comments, which may be most of a page.
REMARKS = frozenset("comment comments commentary respond reply replies disqus discussion".split())
#: First words of a class name that say what is there or not there, not what the element is.
STATES = frozenset("has no with without is not".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
SIGMA = 2.0
CHUNK = 1 << 16
#: Share of the page's text from which a marked part is the page itself: with a headline or an article in it, and without.
WHOLE, NEARLY_ALL = 0.5, 0.9


class Part:
    """A marked element: whether it speaks of comments, holds a headline or an article, and how much text lies in it."""

    __slots__ = ("parent", "remarks", "core", "size", "dropped")

    def __init__(self, parent: int, remarks: bool):
        self.parent, self.remarks, self.core, self.size, self.dropped = parent, remarks, False, 0, False


class Line:
    """One block: its text, its tags, the container and the marked part it lies in."""

    __slots__ = ("parts", "tags", "box", "part", "outside")

    def __init__(self, box: int, part: int, outside: bool):
        self.parts, self.tags, self.box, self.part, self.outside = [], 0, box, part, outside


class Open(tuple):
    """Of an open tag: name, container it is (or 0), container it lies in or is, marked part, outside, inside an article."""

    __slots__ = ()
    tag, own, box, part, outside, article = (property(lambda s, i=i: s[i]) for i in range(6))


class Lines(HTMLParser):
    """Collects lines while events stream in; keeps a forgiving stack of open tags, each with what holds inside it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Open] = []
        self.open = Counter()
        self.kinds, self.above = ["page"], [-1]  # of each container, its tag and the container around it
        self.marked = [Part(-1, False)]  # number 0 stands for no mark
        self.lines = [Line(0, 0, False)]

    def _top(self) -> Open:
        return self.stack[-1] if self.stack else Open(("", 0, 0, 0, False, False))

    def _break(self) -> None:
        top, tags = self._top(), self.lines[-1].tags
        fresh = Line(top.box, top.part, top.outside)
        if self.lines[-1].parts:
            self.lines.append(fresh)
        else:
            self.lines[-1], fresh.tags = fresh, tags

    def _pop(self, at: int) -> None:
        for o in self.stack[at:]:
            self.open[o.tag] -= 1
        del self.stack[at:]

    def _marks(self, tag: str, attrs, article: bool) -> set[str]:
        """The words that speak for something else; of an article or main element only whole names count."""
        found = {"form"} if tag == "form" else set()
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                for name in v.lower().split():
                    words = [w for w in re.split(r"[^a-z]+", name) if w]
                    if tag in ("article", "main"):
                        words = [name]
                    elif words and words[0] in STATES:
                        continue
                    found.update(MARKS.intersection(words))
        if article:  # an article's own head
            found -= {"header", "masthead"}
        return found

    def handle_starttag(self, tag, attrs):
        self.lines[-1].tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self.lines[-1].parts.append(" ")
            return
        if tag in BLOCKS:  # a block ends an open paragraph, an item an open item
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at].tag == "p" or tag in ("li", "dd", "dt", "tr", "td", "th") and self.stack[at].tag == tag:
                    self._pop(at)
                    break
                if self.stack[at].own:
                    break
        top = self._top()
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs)
        outside = top.outside or tag in OUTSIDE or hidden or tag == "header" and not top.article
        part, marks = top.part, self._marks(tag, attrs, top.article) if tag not in ("html", "body") else set()
        if marks and not outside:
            part = len(self.marked)
            self.marked.append(Part(top.part, bool(marks & REMARKS)))
        if tag in ("h1", "article", "main") and not outside:
            self.marked[part].core = True
        own, box = 0, top.box
        if tag in CONTAINERS:
            own = box = len(self.kinds)
            self.kinds.append(tag)
            self.above.append(top.box)
        self.stack.append(Open((tag, own, box, part, outside, top.article or tag in ("article", "main"))))
        self.open[tag] += 1
        if tag in BLOCKS or (part, outside) != (self.lines[-1].part, self.lines[-1].outside):
            self._break()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.lines[-1].tags += 1
        if not self.open[tag]:
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag == tag:
                was = self._top()
                self._pop(at)
                now = self._top()
                if tag in BLOCKS or (was.part, was.outside) != (now.part, now.outside):
                    self._break()
                return
            if self.stack[at].own and tag not in BLOCKS:
                return

    def handle_data(self, data):
        self.lines[-1].parts.append(data)


def _smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    r = int(3 * sigma)
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    return np.convolve(np.pad(x, r), k / k.sum(), mode="valid")


def _threshold(x: np.ndarray) -> float:
    """Border of two clusters of the ratios (means of one dimension, started at the ends)."""
    low, high = float(x.min()), float(x.max())
    for _ in range(50):
        cut = (low + high) / 2
        below, above = x[x <= cut], x[x > cut]
        new = (below.mean() if len(below) else low, above.mean() if len(above) else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _kept(lines: list[tuple[Line, str]], marked: list[Part]) -> list[tuple[Line, str]]:
    """Lines outside the marked parts that are dropped.

    A marked part stays if it is the page itself: it holds half of the text and a headline
    or an article, or nearly all of the text and does not speak of comments.
    """
    total = 0
    for line, text in lines:
        marked[line.part].size += len(text)
        total += len(text)
    for p in reversed(marked[1:]):  # inner parts come after the outer ones
        if p.parent > 0:
            marked[p.parent].size += p.size
            marked[p.parent].core |= p.core and not p.remarks
    for p in marked[1:]:
        page = p.size >= WHOLE * total and p.core or p.size >= NEARLY_ALL * total and not p.remarks
        p.dropped = not page or p.parent > 0 and marked[p.parent].dropped
    return [(line, text) for line, text in lines if not marked[line.part].dropped]


def main_text(html: str | None) -> str:
    """The article's blocks, white space as one blank, joined by one blank.

    Lines are the blocks between block-level tags.  Tags that never belong to an article
    are left out; words of class, id or role only speak against a part, which is dropped
    unless it is the page itself (see ``_kept``).  The text-to-tag ratios of the other lines
    are smoothed and parted in two clusters; lines of the upper one are content.  The region
    is the smallest container (article or main if one is there) with nine tenths of the
    content's text, widened as long as that adds nothing far below the border of the
    clusters.  All its blocks are returned, short ones too.

    The work follows the length of the page, however deep its tags are nested.
    """
    parser = Lines()
    html = html or ""
    for at in range(0, len(html), CHUNK):
        parser.feed(html[at:at + CHUNK])
    parser.close()
    lines = [(line, " ".join("".join(line.parts).split())) for line in parser.lines]
    lines = _kept([(line, text) for line, text in lines if text and not line.outside], parser.marked)
    if not lines:
        return ""
    sizes = np.array([len(t) for _, t in lines], float)
    ratios = _smooth(sizes / np.array([max(1, line.tags) for line, _ in lines]))
    cut = _threshold(ratios)
    content, alike = ratios >= cut, ratios >= cut / 2
    n = len(parser.kinds)
    weight, rest, depth = np.zeros(n), np.zeros(n), np.zeros(n, int)
    for (line, _), size, good, near in zip(lines, sizes, content, alike):
        weight[line.box] += size * good
        rest[line.box] += size * (not near)
    for box in range(n - 1, 0, -1):  # inner containers come after the outer ones
        weight[parser.above[box]] += weight[box]
        rest[parser.above[box]] += rest[box]
    for box in range(1, n):
        depth[box] = depth[parser.above[box]] + 1
    enough = 0.9 * weight[0]
    named = [b for b in range(n) if parser.kinds[b] in ("article", "main") and weight[b] > 0 and weight[b] >= enough / 2]
    if named:
        best = max(named, key=lambda b: (weight[b], depth[b]))
    else:
        best = max((b for b in range(n) if weight[b] >= enough), key=lambda b: (depth[b], -b))
        while best and rest[parser.above[best]] == rest[best]:
            best = parser.above[best]
    inside = np.zeros(n, bool)
    inside[best] = True
    for box in range(best + 1, n):
        inside[box] = inside[parser.above[box]]
    return " ".join(t for line, t in lines if inside[line.box])
def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``: the main text of the whole html.

    Null or empty html, or a page without an article's text, gives an empty text.  Rows are
    judged one by one, so repeated rows and ids stay; other columns are not read.
    """
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, schema)
