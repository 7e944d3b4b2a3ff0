"""Main-text extraction by minimum cut over a page's text blocks.

A page is cut into blocks of running text, each with the elements around it. A linear classifier gives every block a cost
for being called content and one for being called boilerplate: its capacities to the two terminals. Edges join blocks
that follow each other, and blocks that follow each other in one container, the heavier the deeper their common container
lies under the body. The minimum cut is the labelling of least total cost; blocks on the source's side are the main text.
The classifier alone is sure of blocks in marked elements and of long sentences; of short ones, headings and lists outside
an article it isn't, and there the edges decide.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.tables import small_batches
from lattica.llm.workers import tidy

#: Elements whose text is never shown as running text.
HIDDEN = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|select|textarea|title"
#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words of a class, an id or a role, that mark what isn't the article.
BOILERPLATE = frozenset("nav footer aside form menu button dialog fieldset head search".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus feedback footer footnav form gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notification notifications overlay pager pagination popup promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toc toolbar topbar tracking widget alert complementary contentinfo".split())
MAIN = frozenset("article main".split())
MAIN_MARKS = frozenset("article articlebody content entry main post story".split())
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:svg|math)\b[^>]*/>|<({HIDDEN})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S | re.I)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_STOP = re.compile(r"[.!?…。！？][\"'”’)\]]*(?:\s|$)")

#: Weights in whole numbers, so that cuts are exact.
BIAS, IN_MAIN, MARKED, HEADING, PARAGRAPH, PER_WORDS, SENTENCE, LINKED, LISTED = 3, 12, 40, 4, 3, 4, 3, 14, 2
FOLLOWS, TOGETHER = 2, 3


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Block:
    """A run of text between block boundaries, with what is known of the elements around it."""

    __slots__ = ("container", "depth", "heading", "linked", "listed", "main", "marked", "paragraph", "parts", "text", "total")

    def __init__(self, around: "Open | None"):
        self.parts: list[str] = []
        self.linked = self.total = 0
        self.main, self.marked = (around.main, around.marked) if around else (False, False)
        self.heading, self.paragraph, self.listed = (around.heading, around.paragraph, around.listed) if around else (False, False, False)
        self.container, self.depth = (around.container, around.depth) if around else (0, 0)


class Open:
    """An open element, with what it and the elements around it say of the text inside."""

    __slots__ = ("container", "depth", "heading", "listed", "main", "marked", "name", "paragraph")

    def __init__(self, name: str, attributes: str, around: "Open | None", number: int):
        self.name = name
        main = bool(around and around.main)
        marked, own = _marks(name, attributes, main)
        self.main, self.marked = main or own, marked or bool(around and around.marked)
        self.heading = name in _HEADINGS or bool(around and around.heading)
        self.paragraph = name in ("p", "pre", "blockquote") or bool(around and around.paragraph)
        self.listed = name == "li" or bool(around and around.listed)
        self.container, self.depth = (around.container, around.depth) if around else (0, 0)
        if name in BLOCKS and name not in _HEADINGS and name not in ("p", "li"):
            self.container, self.depth = number, self.depth + 1


def _marks(name: str, attributes: str, inside_main: bool) -> tuple[bool, bool]:
    """Whether an element marks boilerplate, and whether it marks the main part."""
    words: set[str] = set()
    if "=" in attributes:
        for m in _NAMES.finditer(attributes):
            value = m[1] or m[2] or m[3] or ""
            words.update(w.lower() for part in _WORD.findall(value) for w in _CAMEL.split(part))
            words.update(w.lower() for w in value.split())
    bad = name in BOILERPLATE or bool(words & MARKS) or (name == "header" or "header" in words) and not inside_main
    return bad, name in MAIN or bool(words & MAIN_MARKS)


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order; character references are decoded and white space is single spaces."""
    out: list[Block] = []
    stack: list[Open] = []
    walls: list[int] = []  # places in the stack of elements that bound blocks
    names: Counter[str] = Counter()  # of the open elements
    block, number, at = None, 0, 0

    def text(piece: str) -> None:
        nonlocal block
        if not piece:
            return
        if block is None:
            block = Block(stack[-1] if stack else None)
            out.append(block)
        block.parts.append(piece)
        size = len(piece) - piece.count(" ")
        block.total += size
        block.linked += size if names["a"] else 0

    for m in _TAG.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            text(" ")
        elif name in VOID:
            block = None if name == "hr" else block
        elif m[2]:
            while names[name]:
                gone = stack.pop().name
                names[gone] -= 1
                if gone in BLOCKS:
                    block = None
                    walls.pop()
                if gone == name:
                    break
            if name in BLOCKS:
                block = None
        elif not m[4].rstrip().endswith("/") or name in BLOCKS:
            if name in BLOCKS:
                block = None
                closes = {"p"} if name not in ("li", "dt", "dd", "option", "tr", "td", "th") else {name, "p"}
                while walls and stack[walls[-1]].name in closes:
                    i = walls.pop()
                    names.subtract(x.name for x in stack[i:])
                    del stack[i:]
                walls.append(len(stack))
            number += 1
            stack.append(Open(name, m[4], stack[-1] if stack else None, number))
            names[name] += 1
    text(page[at:])
    for b in out:
        joined = "".join(b.parts)
        b.text = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
    return [b for b in out if b.text]


def costs(b: Block) -> tuple[int, int]:
    """The costs of calling a block boilerplate, and of calling it content."""
    words = b.text.count(" ") + 1
    good, bad = 0, BIAS
    good += IN_MAIN * b.main + HEADING * (b.heading and b.main) + PARAGRAPH * b.paragraph
    good += min(6, words // PER_WORDS) + SENTENCE * bool(_STOP.search(b.text))
    bad += MARKED * b.marked + LISTED * b.listed
    if b.total:
        bad += LINKED * b.linked // b.total
    return good, bad


def minimum_cut(good: list[int], bad: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut: good and bad are capacities to source and sink.

    A node whose two capacities differ by more than its edges together weigh keeps its side in every minimum cut; such
    nodes are settled first, their edges becoming capacities of their neighbours. Paths are augmented among the others.
    """
    n = len(good)
    gain = [g - b for g, b in zip(good, bad, strict=True)]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    side: list[bool | None] = [None] * n
    weight = [sum(x.values()) for x in near]
    ready = [i for i in range(n) if abs(gain[i]) > weight[i]]
    while ready:
        i = ready.pop()
        if side[i] is not None:
            continue
        side[i] = gain[i] > 0
        for j, w in near[i].items():
            if side[j] is None:
                weight[j] -= w
                gain[j] += w if side[i] else -w
                del near[j][i]
                if abs(gain[j]) > weight[j]:
                    ready.append(j)
    open_ = [i for i in range(n) if side[i] is None]
    left = {i: max(0, gain[i]) for i in open_}  # from the source
    sink = {i: max(0, -gain[i]) for i in open_}
    room = {i: dict(near[i]) for i in open_}
    seen: set[int] = set()  # cut off from the sink: no later path leads out again
    for start in open_:
        while left[start] > 0 and start not in seen:
            came, queue, end = {start: start}, deque([start]), None
            while queue:
                i = queue.popleft()
                if sink[i] > 0:
                    end = i
                    break
                for j, w in room[i].items():
                    if w > 0 and j not in came and j not in seen:
                        came[j] = i
                        queue.append(j)
            if end is None:
                seen.update(came)
                break
            push, i = min(left[start], sink[end]), end
            while i != start:
                push, i = min(push, room[came[i]][i]), came[i]
            left[start] -= push
            sink[end] -= push
            i = end
            while i != start:
                room[came[i]][i] -= push
                room[i][came[i]] += push
                i = came[i]
    return [i in seen if s is None else s for i, s in enumerate(side)]


def network(found: list[Block]) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    """Capacities from the source, to the sink, and between blocks."""
    priced = [costs(b) for b in found]
    edges = [(i, i + 1, FOLLOWS) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if b.container in last:
            edges.append((last[b.container], i, TOGETHER + min(3, b.depth)))
        last[b.container] = i
    return [g for g, _ in priced], [b for _, b in priced], edges


def labelled(page: str | None) -> tuple[list[Block], list[bool], int]:
    """A page's blocks, which of them are content, and how many the cut labels unlike the classifier by itself."""
    found = blocks(page or "")
    good, bad, edges = network(found)
    keep = minimum_cut(good, bad, edges)
    return found, keep, sum(k != (g > b) for k, g, b in zip(keep, good, bad, strict=True))


def main_text(page: str | None) -> str:
    """The page's main text: its content blocks, joined by line feeds. Null, empty and textless pages give ""."""
    found, keep, _ = labelled(page)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """pages(html, ...) without html, with text, n_chars (its code points), n_blocks, and n_turned: how many blocks the
    cut labelled unlike the classifier by itself. Columns of these names are replaced.

    Every row is taken by itself, so repeated rows get equal results, and null ids and urls are kept as they are. A null
    or empty page has an empty text. A page of any length and depth is taken whole. Of labellings that cost the same,
    the one with the fewest content blocks is taken. An empty table gives an empty one.
    """
    own = ["text", "n_chars", "n_blocks", "n_turned"]
    names = [c for c in pages.columns if c not in ("html", *own)]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names), "text string, n_chars long, n_blocks int, n_turned int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for x in part.column("html"):
                    found, keep, turned = labelled(x.as_py())
                    text = "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)
                    rows.append((text, len(text), len(found), turned))
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], [*names, *own])

    return small_batches(pages).select(*names, F.col("html").cast("string").alias("html")).mapInArrow(tidy(run), schema)
