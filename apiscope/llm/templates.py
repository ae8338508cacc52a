"""Main text of HTML pages: site templates are found by counting element subtrees.

Every element outside a page's main part, menus, footers and adverts included,
and every container within it, has a hash of its subtree (its name and text).
Spark counts on how many pages of a host each subtree stands; subtrees that
recur on many pages are the site's template, and are deleted first from every
page of that host.  Of what the counts leave, that goes which is no text of an
article by its element, role or class (menus, forms, scripts and so on).  The
text blocks that remain are joined in page order.

The main part is the page's ``article`` or ``main`` elements if it has any, else
the body.  Headings, paragraphs and other text blocks of an ``article`` or
``main`` are never taken for template: copies of an article, or passages that
many articles share, are text.  Nor is an element that holds a main part, or an
inline element of running text (one in a text block, or beside bare text).

Defined results: a null or empty page has the empty text; broken markup is read
as browsers do (missing end tags are implied, stray ones skipped); a page whose
URL is null or has no host counts under the empty host; text outside any
element is text of the body; repeated pages count as pages of their own.  Whole
pages are read, however long, in time linear in their length, also where elements
nest without end or tags never close; other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, parts, written
from .reputation import url_host

#: Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split())
TEXT_BLOCK = frozenset(
    "p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd table tr td th tbody thead tfoot caption "
    "figure figcaption".split())
#: Elements that hold no text of an article.
DROPPED = RAW | frozenset(
    "head nav footer aside form button select option svg canvas object audio video template dialog "
    "menu map applet".split())
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
    "toolbar".split())
#: Words of class and id names of notices, adverts, menus, sidebars and reader comments.
DROPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|"
    r"popup|modal|overlay|newsletter|subscribe|signup|sidebar|side-bar|aside|nav|navbar|navigation|"
    r"menu|breadcrumbs?|pagination|pager|footer|site-header|masthead|topbar|toolbar|share|sharing|"
    r"social|related|recommend\w*|comments?|respond|disqus|login|search|skip-?link|widget)"
    r"(?:$|[\s_-])", re.I)
#: An end tag of the key closes open elements named in the value, and so does a start tag.
_P_CLOSERS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
           "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
           "tbody": {"tr", "td", "th", "tbody", "thead"}, "body": {"head"}}
_SCOPE = frozenset("table td th ul ol dl div section article main body html aside nav form".split())

_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>")
_NAME = re.compile(r"(/?)([a-zA-Z])")
_NAME_END = re.compile(r"[\s/>]")
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(
    r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_SPACES = [c for c in range(0x3001) if chr(c).isspace()]
_IS_SPACE = np.zeros(_SPACES[-1] + 1, bool)
_IS_SPACE[_SPACES] = True
#: The base of subtree hashes, its inverse, and the powers of both for a stride of letters.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STRIDE = 1 << 14
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(_STRIDE - 1, _BASE, np.uint64)])
_BACK = np.cumprod(np.r_[np.uint64(1), np.full(_STRIDE - 1, _INVERSE, np.uint64)])


class Element:
    __slots__ = ("name", "main", "drop", "text_block", "first", "last", "up", "own", "holds", "running")

    def __init__(self, name, main, drop, text_block, first, up=None):
        self.name, self.main, self.drop, self.text_block = name, main, drop, text_block
        self.first = first     # number of the first piece of text within
        self.last = first
        self.up = up
        self.own = False       # whether text stands directly in it
        self.holds = False     # whether it is or holds a main part
        self.running = False   # whether what it holds is part of running text


class _Tags:
    """Where tags stand in a page, each letter looked at a bounded number of times.

    A tag ends at the first ``>`` outside quotes; a quote that never closes is a
    letter.  Where the pattern runs to the page's end in vain, the ends of all tags
    are found once, from the last mark to the first, and looked up from then on.
    """

    def __init__(self, page: str):
        self.page = page
        self.last_end = page.rfind(">")
        self.marks: list[int] | None = None
        self.ends: list[int] = []
        self.name_end = -1

    def find(self, at: int) -> tuple[int, int, str, str, str] | None:
        """start, end, slash, name and attributes of the next tag (no name: a comment)."""
        page = self.page
        while (i := page.find("<", at)) >= 0:
            if i < self.last_end:
                if self.marks is None:
                    if (m := _TAG.match(page, i)) is not None:
                        return i, m.end(), *m.groups()
                    if _NAME.match(page, i + 1) is not None:
                        self._find_ends()
                elif (found := self._looked_up(i)) is not None:
                    return found
                if page.startswith(("<!", "<?"), i) and not page.startswith("<!--", i):
                    return i, page.index(">", i) + 1, "", "", ""
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                return i, len(page) if end < 0 else end + 3, "", "", ""
            at = i + 1
        return None

    def _looked_up(self, i: int):
        start = _NAME.match(self.page, i + 1)
        if start is None:
            return None
        if self.name_end < start.end():
            m = _NAME_END.search(self.page, start.end())
            self.name_end = len(self.page) if m is None else m.start()
        k = bisect_left(self.marks, self.name_end)
        end = self.ends[k] if k < len(self.marks) else -1
        if end < 0:
            return None
        return (i, end + 1, start.group(1), self.page[start.start(2):self.name_end],
                self.page[self.name_end:end])

    def _find_ends(self) -> None:
        self.marks = [m.start() for m in _MARK.finditer(self.page)]
        self.ends = [-1] * (len(self.marks) + 1)
        later: dict[str, int] = {}
        for k in range(len(self.marks) - 1, -1, -1):
            mark = self.page[self.marks[k]]
            if mark == ">":
                self.ends[k] = self.marks[k]
            else:
                self.ends[k] = self.ends[later.get(mark, k) + 1]
                later[mark] = k


def _drops(name: str, attributes: str, in_main: bool) -> bool:
    """Whether an element is none of an article's by its name, role or class."""
    if name in DROPPED or name == "header" and not in_main:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role" and value.lower() in DROPPED_ROLES:
            return True
        if key in ("class", "id") and DROPPED_NAMES.search(value):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def parse(page: str) -> tuple[list[str], list[Element], bool]:
    """Pieces of text, elements in page order, and whether there is a main part.

    A block's edge is a piece of its own, a single space.
    """
    pieces: list[str] = []
    elements: list[Element] = []
    stack: list[Element] = []
    depths: dict[str, list[int]] = {}    # where open elements of a name stand
    tags = _Tags(page)
    root = Element("body", False, False, False, 0)
    has_main = False
    at = 0

    def add(text: str) -> None:
        pieces.append(html.unescape(text))
        if text.strip():
            (stack[-1] if stack else root).own = True

    def close(depth: int) -> None:
        while len(stack) > depth:
            element = stack.pop()
            depths[element.name].pop()
            if element.name not in INLINE:
                pieces.append(" ")
            element.last = len(pieces)

    def deepest(names) -> int:
        return max((d[-1] for n in names if (d := depths.get(n))), default=-1)

    def close_named(names, scope) -> None:
        depth = deepest(names)
        if depth >= 0 and (depth == len(stack) - 1 or depth >= deepest(scope)):
            close(depth)

    n = len(page)
    while at < n:
        found = tags.find(at)
        if found is None:
            add(page[at:])
            break
        start, end, slash, name, attributes = found
        if start > at:
            add(page[at:start])
        at = end
        if not name:
            continue
        name = name.lower()
        if slash:
            if depths.get(name):
                close(depths[name][-1])
            continue
        if name in VOID:
            if name not in INLINE:
                pieces.append(" ")
            continue
        if name in _P_CLOSERS:
            close_named({"p"}, _SCOPE)
        if name in _CLOSES:
            close_named(_CLOSES[name], _SCOPE - _CLOSES[name] - {"td", "th"}
                        if name in ("tr", "tbody") else _SCOPE - _CLOSES[name])
        inside = bool(stack) and stack[-1].main
        drop = _drops(name, attributes, inside)
        main = inside or not drop and (name in ("article", "main") or "role" in attributes
                                       and re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I)
                                       is not None)
        dropped = drop or bool(stack) and stack[-1].drop
        has_main |= main and not dropped
        if name not in INLINE:
            pieces.append(" ")
        element = Element(name, main and not dropped, dropped, name in TEXT_BLOCK, len(pieces),
                          stack[-1] if stack else root)
        elements.append(element)
        if element.main and not inside:
            element.holds = True
            for e in reversed(stack):
                if e.holds:
                    break
                e.holds = True
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end is not None:
                at = end.end()
            else:  # a raw element that never ends holds the rest
                at = n
            element.last = len(pieces)
            continue
        depths.setdefault(name, []).append(len(stack))
        stack.append(element)
    close(0)
    for e in [root, *elements]:  # an element stands after the one that holds it
        e.running = e.up.running if e.up and e.name in INLINE and not e.own else e.own or e.text_block
    return pieces, elements, has_main


def _hashes(pieces: list[str]) -> Callable[[list[int], list[int]], list[int | None]]:
    """A function that gives the hashes of the texts from pieces to pieces.

    White space is made one space and cut off at both ends, so an element's text is a
    part of the page's: all are hashed from running sums of powers times code
    points, modulo 2^64, whose base is odd and so has an inverse.  Every letter is
    looked at once, however deep elements nest.  None: no text.
    """
    page = "".join(pieces)
    edges = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(p) for p in pieces], out=edges[1:])
    code = np.frombuffer(page.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.zeros(len(code), bool)
    low = code <= _SPACES[-1]
    blank[low] = _IS_SPACE[code[low]]
    kept = ~blank
    kept[1:] |= ~blank[:-1]
    if len(kept):
        kept[0] = True
    place = np.zeros(len(code) + 1, np.int64)
    np.cumsum(kept, out=place[1:])
    code, blank = np.where(blank, 32, code)[kept], blank[kept]
    before = np.zeros(len(code) + 1, np.uint64)
    inverse = np.ones(len(code) + 1, np.uint64)
    for start in range(0, len(code), _STRIDE):
        part = code[start:start + _STRIDE].astype(np.uint64)
        scale = np.uint64(pow(_BASE, start, 1 << 64))
        back = np.uint64(pow(_INVERSE, start, 1 << 64))
        m = len(part)
        np.cumsum(part * (_POWERS[:m] * scale), out=before[start + 1:start + m + 1])
        before[start + 1:start + m + 1] += before[start]
        inverse[start:start + m] = _BACK[:m] * back

    def of(first: list[int], last: list[int]) -> list[int | None]:
        a, b = place[edges[first]], place[edges[last]]
        a = np.where((a < b) & np.append(blank, False)[a], a + 1, a)
        b = np.where((a < b) & np.append(blank, False)[b - 1], b - 1, b)
        sums = ((before[b] - before[a]) * inverse[a]).tolist()
        return [h if n > 0 else None for h, n in zip(sums, (b - a).tolist(), strict=True)]

    return of


def _subtrees(pieces: list[str], elements: list[Element]) -> Iterator[tuple[Element, int]]:
    """The elements that may be template, and the hashes of their subtrees (name and text)."""
    wanted = []
    for e in elements:
        if not e.drop:
            if e.holds or e.name in ("html", "body", "article", "main"):
                continue
            if e.main and (e.text_block or e.name in INLINE) or e.name in INLINE and e.up.running:
                continue
        wanted.append(e)
    if not wanted:
        return
    texts = _hashes(pieces)([e.first for e in wanted], [e.last for e in wanted])
    for e, h in zip(wanted, texts, strict=True):
        if h is not None:
            yield e, xxhash.xxh64_intdigest(h.to_bytes(8, "little"), xxhash.xxh32_intdigest(e.name)) - (1 << 63)


def _within(spans: list[Element], n: int) -> np.ndarray:
    """Whether each of ``n`` pieces lies in one of the elements."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, [e.first for e in spans], 1)
    np.add.at(change, [e.last for e in spans], -1)
    return np.cumsum(change[:-1]) > 0


def candidates(page: str) -> set[int]:
    """Hashes of the subtrees of a page that may be template."""
    pieces, elements, _ = parse(page)
    return {h for _, h in _subtrees(pieces, elements)}


def main_text(page: str, template: set[int]) -> str:
    """The page's main text, without the subtrees in ``template``."""
    pieces, elements, has_main = parse(page)
    gone = [e for e in elements if e.drop]
    if template:
        gone += [e for e, h in _subtrees(pieces, elements) if h in template]
    keep = ~_within(gone, len(pieces))
    if has_main:
        keep &= _within([e for e in elements if e.main], len(pieces))
    return _SPACE.sub(" ", "".join(p if k else " " if p == " " else ""
                                   for p, k in zip(pieces, keep.tolist(), strict=True))).strip()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, "html"):
        pages, hosts, hashes = [], [], []
        for row, host, page in zip(part.column("row").to_pylist(), part.column("host").to_pylist(),
                                   part.column("html").to_pylist(), strict=True):
            for h in candidates(page or ""):
                pages.append(row)
                hosts.append(host)
                hashes.append(h)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pages, pa.int64()), pa.array(hosts, pa.string()),
             pa.array(hashes, pa.int64())], ["row", "host", "hash"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, "html"):
        out = [main_text(page or "", set(template or ())) for page, template in
               zip(part.column("html").to_pylist(), part.column("template").to_pylist(),
                   strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array(out, pa.string()),
             pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, min_pages: int = 5, min_share: float = 0.3,
            many_pages: int = 100) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A subtree is template if it stands on at least ``min_pages`` pages of its
    host and on at least ``min_share`` of them, or on ``many_pages`` of them: those
    are many however large and mixed the host is.  ``pages`` has ``page_id``,
    ``url`` and ``html``.
    """
    hosted = bounded(pages).select("page_id", "url", "html", url_host(F.col("url")).alias("host"))
    # a page is known by what it is, so that a retried task names it alike
    keyed = hosted.withColumn("row", F.xxhash64("page_id", "url", "html"))
    subtrees = written(keyed.select("row", "host", "html").mapInArrow(
        _counted, "row long, host string, hash long"), "subtrees")
    counts = subtrees.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    totals = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(
        F.col("pages") >= min_pages)
    template = written(counts.where(F.col("n") >= min_pages).join(totals, "host").where(
        (F.col("n") >= min_share * F.col("pages")) | (F.col("n") >= many_pages)).select("host", "hash"), "template")
    marked = written(subtrees.join(template, ["host", "hash"]).groupBy("row").agg(
        F.collect_set("hash").alias("template")), "template-pages")
    return keyed.select("page_id", "url", "html", "row").join(marked, "row", "left").drop(
        "row").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
