"""Main text of html pages by minimum-cut labelling.

A page becomes a row of text blocks in page order. A linear classifier gives every block a cost for the label it speaks
against (its words, links, elements around it, names of classes): the capacity of its edge from the source (content) or to
the sink (boilerplate). The costs are mild: a heading, a short line or one name of a class leave a block undecided by itself.
Smoothness edges join neighbours in the page, weighing more the nearer they are in the tree, and the minimum cut separates
content from the rest. Blocks whose own cost outweighs all their edges keep their label in any minimum cut, so they are
settled first and turn into costs of their neighbours; the maximum flow is searched on what is left, component by component.

Reading takes time in proportion to the page: tags are read once from left to right, each open element knows what may end
it, and nearness in the tree is the least depth between two blocks, so neither deep nesting nor broken quotes cost more.

Null or empty html, or none with text, and an empty table: an empty text, an empty result. Very long pages are read whole.
Truncated pages are read as far as they go; from a quote on that never ends, tags end at their first `>`. Of several minimum
cuts the one with most blocks as boilerplate wins. Repeated rows get equal results; null ids and urls pass through. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintlake.llm.shared import only

_OPENING = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")

# Elements by what they do to text.
RAW = frozenset("script style title textarea noscript template iframe object svg math xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Groups of elements of which an opening one ends the last, unless an element that bounds the group was opened since.
GROUPS = [({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}), ({"tr"}, {"table"}), ({"td", "th"}, {"tr", "table"}), ({"option"}, {"select"})]
#: An opening block ends an open paragraph, unless one of these is in between.
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
KEEPS_PARAGRAPH = frozenset("button table td th caption object applet marquee".split())

# The classifier: what an element or name around a block adds to its leaning to content.
AROUND = {"article": 2.5, "main": 2.5, "nav": -4.0, "footer": -4.0, "aside": -4.0, "form": -4.0, "menu": -4.0, "dialog": -4.0, "select": -4.0, "button": -3.0, "fieldset": -3.0, "header": -3.0}
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status note".split())
GOOD_NAMES = frozenset("article content post entry story body main text maintext prose".split())
BAD_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side rail nav navbar navigation menu submenu
    breadcrumb breadcrumbs footer foot header masthead topbar cookie cookies consent gdpr notice notification alert popup modal overlay newsletter
    subscribe subscription signup login signin register share sharing social related recommended recommendations more-stories comment comments
    commentlist disqus reply replies respond discussion widget pagination pager toolbar tagcloud skip copyright disclaimer search searchform""".split()
)
#: What is not shown; a bad or good role or whole name of a container, one word of such a name; a block outside a marked article.
HIDDEN, BAD, PARTLY, GOOD, ELSEWHERE = -20.0, -4.5, -2.0, 0.8, -1.5
#: The same for elements that hold a single block: a class, an id (mostly the target of a link), one word of either.
OWN_CLASS, OWN_ID, OWN_PART = -3.0, -1.0, -0.5
SINGLE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th caption figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What every block has to make up for.
BIAS = -1.0
#: Weight of the edge between blocks next to each other with the same parent.
SMOOTH = 0.8


class Block:
    """low: the least depth of the tree between this block and the one before."""

    __slots__ = ("text", "depth", "low", "lean", "marked", "linked", "tag")

    def __init__(self, text: str, depth: int, low: int, lean: float, marked: bool, linked: int, tag: str):
        self.text, self.depth, self.low, self.lean, self.marked, self.linked, self.tag = text, depth, low, lean, marked, linked, tag


def leaning(tag: str, attributes: str) -> float:
    """What an element adds to the leaning of the blocks in it."""
    out = AROUND.get(tag, 0.0)
    if not attributes or tag in ("html", "body"):
        return out
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return HIDDEN
        if name == "role":
            out += BAD if value in BAD_ROLES else AROUND["article"] if value in ("main", "article") else 0.0
        elif name in ("class", "id"):
            whole = set(value.split())
            words = {w for part in whole for w in re.split(r"[-_]+", part)}
            if whole & BAD_NAMES:
                out += BAD if tag not in SINGLE else OWN_CLASS if name == "class" else OWN_ID
            elif words & BAD_NAMES:
                out += PARTLY if tag not in SINGLE else OWN_PART
            elif words & GOOD_NAMES:
                out += GOOD
    return out


class Open:
    """An open element: the leaning of all so far, whether it is in a link or a marked article, its depth without inline elements, and the open paragraph that a block would end."""

    __slots__ = ("tag", "lean", "linked", "marked", "depth", "paragraph", "block")

    def __init__(self, tag: str, lean: float, linked: bool, marked: bool, depth: int, paragraph: int, block: str):
        self.tag, self.lean, self.linked, self.marked, self.depth, self.paragraph, self.block = tag, lean, linked, marked, depth, paragraph, block


def split_blocks(page: str) -> list[Block]:
    """The blocks of text of a page, white space runs as one space, character references decoded."""
    out: list[Block] = []
    stack = [Open("", 0.0, False, False, 0, 0, "")]
    count: dict[str, int] = {}  # open elements by tag
    last: list[list[tuple[int, bool]]] = [[] for _ in GROUPS]  # their places in the stack: of a group or bounding it
    held: list[str] = []
    linked, low, at, broken, size = 0, 0, 0, False, len(page)

    def take(raw: str) -> None:
        nonlocal linked
        if raw:
            held.append(raw)
            if stack[-1].linked:
                linked += len(raw)

    def flush() -> None:
        nonlocal linked, low
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                top = stack[-1]
                out.append(Block(text, top.depth, min(low, top.depth), top.lean, top.marked, linked, top.block))
                low = top.depth
            held.clear()
        linked = 0

    def close(i: int) -> None:
        nonlocal low
        for e in stack[i:]:
            count[e.tag] -= 1
        del stack[i:]
        low = min(low, stack[-1].depth)
        for places in last:
            while places and places[-1][0] >= i:
                places.pop()

    while at < size and (m := _OPENING.search(page, at)):
        take(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                take(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = m[2].lower()
        rest = None if broken else _REST.match(page, at)
        if rest:
            attributes, at = rest[1], rest.end()
        else:
            broken = True
            if (end := page.find(">", at)) < 0:  # the page's end cuts the tag off
                at = size
                break
            attributes, at = page[at:end], end + 1
        if m[1]:
            if tag not in INLINE:
                flush()
            if count.get(tag):
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in RAW:
            if not (attributes.endswith("/") and tag in ("svg", "math")):
                ended = _RAW_END[tag].search(page, at)
                at = (page.find(">", ended.end()) + 1 or size) if ended else size
            continue
        if tag == "br":
            take("\n")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            if stack[-1].paragraph:
                close(stack[-1].paragraph)
            for (own, _), places in zip(GROUPS, last, strict=True):
                if tag in own and places and places[-1][1]:
                    close(places[-1][0])
            if attributes.endswith("/"):
                continue
        top, i = stack[-1], len(stack)
        count[tag] = count.get(tag, 0) + 1
        if tag in INLINE:
            stack.append(Open(tag, top.lean, top.linked or tag == "a", top.marked, top.depth, top.paragraph, top.block))
            continue
        own_lean = leaning(tag, attributes)
        for (own, bounds), places in zip(GROUPS, last, strict=True):
            if tag in own or tag in bounds:
                places.append((i, tag in own))
        paragraph = i if tag == "p" else 0 if tag in KEEPS_PARAGRAPH else top.paragraph
        stack.append(Open(tag, top.lean + own_lean, top.linked, top.marked or own_lean > 0, top.depth + 1, paragraph, tag))
    take(page[at:])
    flush()
    return out


def costs(blocks: list[Block]) -> list[float]:
    """Leaning of each block: above 0 the cost of calling it boilerplate, below 0 that of calling it content."""
    marked = any(b.marked for b in blocks)
    out = []
    for b in blocks:
        n = len(b.text)
        lean = BIAS + b.lean + min(n, 300) / 150 - 2.0 * min(1.0, b.linked / n)
        lean += 0.5 if b.text[-1] in ".!?…。:;\"”" else -0.5 if n < 60 else 0.0
        if marked and not b.marked:
            lean += ELSEWHERE
        if b.tag in HEADINGS:  # goes with what is next to it
            lean -= 1.5
        elif b.tag in ("p", "pre", "blockquote"):
            lean += 0.3
        out.append(lean)
    return out


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges (i, j, weight) between neighbours and those next but one."""
    out = []
    for step in (1, 2):
        for i in range(len(blocks) - step):
            a, b = blocks[i], blocks[i + step]
            common = min(x.low for x in blocks[i + 1 : i + step + 1])
            apart = a.depth + b.depth - 2 * common
            out.append((i, i + step, SMOOTH / step / (1 + max(0, apart - 2)) ** 2))
    return out


def cut(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of a minimum cut: true on the source's side. Of several the one with most blocks on the sink's side."""
    n = len(lean)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    lean, label = list(lean), [None] * n
    todo = deque(range(n))
    while todo:  # what outweighs its edges is settled
        i = todo.popleft()
        if label[i] is not None or abs(lean[i]) <= sum(near[i].values()):
            continue
        label[i] = lean[i] > 0
        for j, w in near[i].items():
            lean[j] += w if label[i] else -w
            del near[j][i]
            todo.append(j)
        near[i].clear()
    for first in range(n):
        if label[first] is None:
            part, seen = [first], {first}
            for i in part:
                for j in near[i]:
                    if j not in seen:
                        seen.add(j)
                        part.append(j)
            inside = _flow(part, lean, near)
            for i in part:
                label[i] = i in inside
    return label


def _flow(part: list[int], lean: list[float], near: list[dict[int, float]]) -> set[int]:
    """The source's side of a minimum cut of one component, by shortest augmenting paths."""
    left: dict[int, dict[int, float]] = {i: dict(near[i]) for i in part}
    left[-1], left[-2] = {}, {}
    for i in part:
        if lean[i] > 0:
            left[-1][i], left[i][-1] = lean[i], 0.0
        elif lean[i] < 0:
            left[i][-2], left[-2][i] = -lean[i], 0.0
    while True:
        came, queue = {-1: -1}, deque([-1])
        while queue and -2 not in came:
            i = queue.popleft()
            for j, c in left[i].items():
                if c > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if -2 not in came:
            return set(came) - {-1}
        path, j = [], -2
        while j != -1:
            path.append((came[j], j))
            j = came[j]
        room = min(left[i][j] for i, j in path)
        for i, j in path:
            left[i][j] -= room
            left[j][i] = left[j].get(i, 0.0) + room


def main_text(page: str | None) -> str:
    blocks = split_blocks(page or "")
    return " ".join(b.text for b, keep in zip(blocks, cut(costs(blocks), smoothness(blocks)), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return only(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
