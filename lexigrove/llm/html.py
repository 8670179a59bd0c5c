"""Main text of HTML pages by composite text density.

The density of a DOM node is its characters per tag, weighed down by its share of links against the body's. The sum of the
densities of a node's children is greatest where the text is; that subtree is the content. The least density on the way
from it up to the body is the threshold: other nodes that reach it, down from the body, add the subtree of the greatest sum that they hold.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..arrow import slices
from .common import col

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|title)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)",
    re.S | re.I,
)
_SPACES = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
BLOCK = _CLOSES_P | frozenset("li dt dd tr td th thead tbody tfoot caption option br body html".split())
#: A start tag ends the open elements of these names, up to the nearest of the bounds.
_SIBLINGS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
_P_BOUNDS = frozenset({"table", "td", "th", "button", "object", "caption", "body", "html", "template"})
LINKS = frozenset({"a", "button", "select"})


@dataclass
class Page:
    """Nodes in document order: tag, parent, and the half-open range of the segments of text that lie below each."""

    tags: list[str] = field(default_factory=lambda: ["#document"])
    parents: list[int] = field(default_factory=lambda: [-1])
    begin: list[int] = field(default_factory=lambda: [0])
    end: list[int] = field(default_factory=lambda: [0])
    segments: list[str] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)
    body: int = 0


def parse(source: str) -> Page:
    """The tree of a page, with the repairs that browsers make for left-out end tags; text outside a body that is there, or in head, doesn't count."""
    page = Page()
    tags, parents, begin, end, segments, owners = page.tags, page.parents, page.begin, page.end, page.segments, page.owners
    stack = [0]
    depths: dict[str, list[int]] = {}  # of each tag's open elements, outermost first

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            end[node] = len(segments)
            if stack:
                depths[tags[node]].pop()

    def close_open(names: frozenset, bounds: frozenset) -> None:
        bound = max((depths[x][-1] for x in bounds if depths.get(x)), default=0)
        outermost = None
        for x in names:
            mine = depths.get(x)
            if mine and mine[-1] > bound:
                first = mine[bisect_right(mine, bound)]
                outermost = first if outermost is None else min(outermost, first)
        if outermost is not None:
            close_to(outermost)

    def text(part: str) -> None:
        if part:
            segments.append(html.unescape(part) if "&" in part else part)
            owners.append(stack[-1])

    at = 0
    for m in _TOKEN.finditer(source):
        text(source[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if m.group(2):
            if depths.get(name):
                close_to(depths[name][-1])
            if name in BLOCK:
                text("\n")
            continue
        if name in _CLOSES_P:
            close_open(frozenset({"p"}), _P_BOUNDS)
        if name in _SIBLINGS:
            close_open(*_SIBLINGS[name])
        if name == "body":
            close_open(frozenset({"head"}), frozenset())
        if name in BLOCK:
            text("\n")
        node = len(tags)
        tags.append(name)
        parents.append(stack[-1])
        begin.append(len(segments))
        end.append(len(segments))
        if name == "body" and not page.body:
            page.body = node
        if name not in VOID:
            depths.setdefault(name, []).append(len(stack))
            stack.append(node)
    text(source[at:])
    close_to(0)
    return page


def density(chars: float, tags: float, link_chars: float, link_tags: float, body_ratio: float) -> float:
    """Composite text density; where a page has no link at all, characters per tag."""
    if not chars:
        return 0.0
    plain = chars / max(tags, 1)
    base = math.log(math.log(chars / max(chars - link_chars, 1) * link_chars + body_ratio * chars + math.e))
    if base <= 0:
        return plain
    return plain * math.log(chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)) / base


@dataclass
class Content:
    text: str
    path: str
    density_sum: float
    threshold: float


def densities(page: Page) -> tuple[list[float], list[float]]:
    """The density of every node, and the sum of its children's."""
    n = len(page.tags)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    inside = [False] * n
    for i in range(1, n):
        inside[i] = inside[page.parents[i]] or page.tags[i] in LINKS
    for owner, segment in zip(page.owners, page.segments, strict=True):
        size = len(segment) if " " not in segment and "\n" not in segment else len(_SPACES.sub(" ", segment).strip())
        if segment == "\n":
            size = 0
        chars[owner] += size
        if inside[owner]:
            link_chars[owner] += size
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (page.tags[i] in LINKS)
    b = page.body
    ratio = link_chars[b] / max(chars[b], 1)
    value = [density(*x, ratio) for x in zip(chars, tags, link_chars, link_tags, strict=True)]
    sums = [0.0] * n
    for i in range(n - 1, 0, -1):
        sums[page.parents[i]] += value[i]
    return value, sums


def extract(source: str) -> Content:
    """The content of a page; a page without an element that has text gives all its text, if any."""
    page = parse(source)
    value, sums = densities(page)
    n, body = len(page.tags), page.body
    last = list(range(n))  # the last node of each subtree
    for i in range(n - 1, 0, -1):
        last[page.parents[i]] = max(last[page.parents[i]], last[i])
    best = max(range(body, last[body] + 1), key=lambda i: (sums[i], -i))
    on_way, at = [value[best]], best
    while at != body:
        at = page.parents[at]
        on_way.append(value[at])
    threshold = min(on_way)
    # the best node of each subtree, first in document order among equals
    top = list(range(n))
    for i in range(n - 1, body, -1):
        p = page.parents[i]
        if (sums[top[i]], -top[i]) > (sums[top[p]], -top[p]):
            top[p] = top[i]
    marked = {best}
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(body + 1, last[body] + 1):
        children[page.parents[i]].append(i)
    stack = [body]
    while stack:
        i = stack.pop()
        if value[i] >= threshold and sums[top[i]] > 0:
            marked.add(top[i])
            stack += children[i]
    spans = sorted((page.begin[i], page.end[i]) for i in marked)
    parts, at = [], 0
    for a, b in spans:
        parts += page.segments[max(a, at) : b]
        at = max(at, b)
    lines = (_SPACES.sub(" ", line).strip() for line in "".join(parts).replace("\r", "").split("\n"))
    names, at = [], best
    while at > 0:
        names.append(page.tags[at])
        at = page.parents[at]
    return Content("\n".join(x for x in lines if x), "/".join(reversed(names)), round(sums[best], 6), round(threshold, 6))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 1, 1 << 22)):
        found = [None if x is None else extract(x) for x in batch.column(1).to_pylist()]
        columns = [
            pa.array([f and f.text for f in found], pa.string()),
            pa.array([None if f is None else len(f.text) for f in found], pa.int32()),
            pa.array([f and f.path for f in found], pa.string()),
            pa.array([None if f is None else f.density_sum for f in found], pa.float64()),
            pa.array([None if f is None else f.threshold for f in found], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["page_id", "text", "n_chars", "path", "density_sum", "threshold"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars, path, density_sum, threshold) of each row: the content of its page and the tags on the way to it.

    Of a null page all but the id is null; an empty page, or one without text, gives the empty text. Ties go to the node that
    begins first. A page may be of any length and depth. Rows are taken each by itself, so repeated rows agree and null ids stay. An empty table gives no rows.
    """
    plain = pages.select(col(pages, id_col).cast("long").alias("page_id"), col(pages, html_col).cast("string").alias("html"))
    return plain.mapInArrow(_run, "page_id long, text string, n_chars int, path string, density_sum double, threshold double")
