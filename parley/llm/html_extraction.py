"""Operator 8: main-text extraction by minimum cut.

A page is cut into text blocks at block-level tags. A logistic classifier on
text features (length, link share, punctuation, tag, place) gives each block
the odds of being content, clipped to ``CLIP``. What the enclosing elements
tell (tags, roles, words in class names) adds log-odds of at most the same
size, so neither decides alone. The sum is the block's cost of being content or
boilerplate: the capacity of its edge to a terminal. Consecutive blocks and
blocks of one parent are joined by smoothness edges, weaker the further they
are apart in the document tree. The minimum cut is the labelling of least
cost: blocks whose terminal outweighs all their edges are settled first, which
changes no least cost, and maximum flow settles the rest.

The classifier is trained on a bounded sample of the pages themselves: blocks
inside ``article`` or ``main`` tags against blocks inside ``nav``, ``aside``,
``footer`` and the like; class names take no part. ``fit_pages`` is the bound;
every page is labelled. Time and memory are linear in the page, but for the flow.

Defined cases: null or empty html gives an empty text; broken markup is read
to its end; pages without a sample use the classifier's starting weights;
repeated rows and null ids give one row each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import columns

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]{0,1024}+\"|'[^']{0,1024}+'|[^>\"']++){0,256}+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)(?:>|(?=<)|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# fixed values: element names of the HTML standard by what they do
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
AWAY = {"nav", "footer", "aside", "menu", "dialog", "button", "select", "svg", "canvas", "object", "audio", "video", "map", "head"}
MAIN = {"article", "main"}
FORMS = {"form", "fieldset"}
# fixed values: words in class and id names
AWAY_WORDS = set(
    "ad ads advert adverts advertisement adsense sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr popup modal "
    "newsletter signup login comment comments disqus reply replies respond pagination pager copyright".split()
)
#: Words that may as well be about the subject of a text.
DOUBTFUL_WORDS = set("promo promotion banner side foot header notice notices alert warning disclaimer overlay subscribe subscription search form share sharing social related recommended recommendations widget skip legal".split())
MAIN_WORDS = {"article", "post", "entry", "story", "content", "main"}
#: A name with one of these tells about the page's layout, not about the element ("has-sidebar").
LAYOUT_WORDS = {"has", "with", "no", "without", "layout", "grid"}
#: What elements tell of the blocks in them, from their tags and roles (TAG) or their class names (WORD).
MAIN_TAG, MAIN_WORD, FORM, DOUBTFUL, AWAY_WORD, AWAY_TAG, HIDDEN = 2, 1, -1, -2, -3, -4, -5
#: Largest log-odds of the classifier, and what the innermost main element or the strongest boilerplate element within it adds.
CLIP = 4.0
EVIDENCE = {0: 0.0, MAIN_TAG: 1.0, MAIN_WORD: 1.0, FORM: -1.0, DOUBTFUL: -2.0, AWAY_WORD: -4.0, AWAY_TAG: -4.0}
#: Starting weights of the classifier: one for each feature of ``Block.vector``.
START = (-0.3, 0.5, -5.0, 1.0, 0.8, 0.3, -0.8, 0.5)
SMOOTH = 2.0


class Element:
    """A block-level element of the document tree."""

    __slots__ = ("depth", "parent")

    def __init__(self, parent: Element | None) -> None:
        self.parent, self.depth = parent, parent.depth + 1 if parent else 0


class Block:
    __slots__ = ("element", "evidence", "linked", "pieces", "tag", "text")

    def __init__(self, tag: str, element: Element, evidence: int) -> None:
        self.tag, self.element, self.evidence, self.pieces, self.linked = tag, element, evidence, [], 0

    def vector(self, place: float) -> tuple[float, ...]:
        size = max(1, len(self.text))
        return (1.0, math.log1p(size) - 4, min(1.0, self.linked / size), sum(map(self.text.count, ".,;!?")) / size * 20, float(self.tag in ("", "p", "pre", "blockquote")), float(self.tag in HEADINGS), float(self.tag in ("li", "td", "dd")), 1 - 2 * abs(place - 0.5))


def _kind(tag: str, attributes: str, around: int) -> int:
    """Evidence inside an element, given the evidence around it."""
    if around == HIDDEN:
        return HIDDEN
    inside_main = around > 0
    own = FORM if tag in FORMS else AWAY_TAG if tag in AWAY or tag == "header" and not inside_main else 0
    main = tag in MAIN
    if attributes:
        given = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
        if "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")):
            return HIDDEN
        role = given.get("role")
        if role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"):
            own = AWAY_TAG
        elif role == "form":
            own = min(own, FORM)
        main = main or role == "main"
        if tag not in ("html", "body") and own > AWAY_TAG:
            names = [{w.lower() for w in _NAME.findall(name)} for k in ("class", "id") for name in given.get(k, "").split()]
            names = [n for n in names if not n & LAYOUT_WORDS]
            words = set().union(*names)
            away, named = words & AWAY_WORDS, words & MAIN_WORDS
            # inside a main element, a doubtful word tells something only if it stands alone
            doubtful = set().union(*(n & DOUBTFUL_WORDS for n in names if not inside_main or len(n) == 1)) - ({"form"} if tag in FORMS else set())
            if inside_main or named and not away and doubtful <= {"header", "side", "foot"}:
                doubtful -= {"header", "side", "foot"}
            # a main element that is not inside another one, or inside what is away, is one whatever its class says
            if (away or doubtful) and not (main and around in (0, FORM)):
                own = min(own, AWAY_WORD if away else DOUBTFUL)
            elif named and not away and not doubtful and not own and around >= FORM and tag in ("div", "section", "td"):
                return max(MAIN_WORD, around)
    if own < 0:
        return min(own, around)
    if main:  # in a nav, footer or aside, or among comments, it may be a teaser or a comment
        return DOUBTFUL if around == AWAY_TAG else MAIN_TAG
    return around


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, with their elements and the evidence around them."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = [("", 0)]  # tag, evidence with what is around it
    outer: list[tuple[str, int, Element]] = [("", 0, Element(None))]  # the same of block-level elements, with their place in the tree
    open_: Counter[str] = Counter()
    current: Block | None = None
    at = 0

    def text(piece: str) -> None:
        nonlocal current
        if not piece:
            return
        tag, evidence, element = outer[-1]
        if stack[-1][1] < min(0, evidence):
            return  # an inline element that is not content
        if current is None:
            if not piece.strip():
                return
            current = Block(tag, element, evidence)
            out.append(current)
        current.pieces.append(piece)
        if open_["a"]:
            current.linked += len(piece)

    def close() -> str:
        tag, _ = stack.pop()
        open_[tag] -= 1
        if tag not in INLINE:
            outer.pop()
        return tag

    while (m := _TOKEN.search(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag not in INLINE:
            current = None
        if closing:
            if open_[tag]:
                while close() != tag:
                    pass
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:  # an open paragraph ends at the next block element, an item at the next item
            last = outer[-1][0]
            if last == "p" or tag in ("li", "dt", "dd", "option", "tr", "td") and last == tag:
                while close() != last:
                    pass
        evidence = _kind(tag, m[3] or m[6] or "", stack[-1][1])
        stack.append((tag, evidence))
        open_[tag] += 1
        if tag not in INLINE:
            outer.append((tag, evidence, Element(outer[-1][2])))
    text(page[at:])
    kept = []
    for b in out:
        b.text = " ".join(entities.unescape("".join(b.pieces)).split())
        if b.text and b.evidence != HIDDEN:
            kept.append(b)
    return kept


def minimum_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut.

    ``gain``: capacity from the source if positive, to the sink if negative;
    ``edges``: undirected (a, b, capacity). A node whose capacity to a terminal
    is at least that of all its edges lies on that side of some minimum cut; it
    is settled, its edges add to its neighbours' capacities, and so on. The
    others are cut by maximum flow.
    """
    n, gain = len(gain), list(gain)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    room = [0] * n
    for a, b, c in edges:
        near[a].append((b, c))
        near[b].append((a, c))
        room[a] += c
        room[b] += c
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        a = todo.pop()
        if side[a] is None and abs(gain[a]) >= room[a]:
            side[a] = gain[a] >= 0
            for b, c in near[a]:
                if side[b] is None:
                    gain[b] += c if side[a] else -c
                    room[b] -= c
                    todo.append(b)
    left = [i for i in range(n) if side[i] is None]
    name = {i: k for k, i in enumerate(left)}
    found = _by_flow([gain[i] for i in left], [(name[a], name[b], c) for a, b, c in edges if a in name and b in name]) if left else []
    for i, s in zip(left, found, strict=True):
        side[i] = s
    return side


def _by_flow(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The source side of the minimum cut by Dinic's maximum flow."""
    n = len(gain)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def join(a: int, b: int, there: int, back: int) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, g in enumerate(gain):
        if g > 0:
            join(source, i, g, 0)
        elif g < 0:
            join(i, sink, -g, 0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if not room[e])
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while place[a] < len(graph[a]):
                e = graph[a][place[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                place[a] += 1
            if place[a] < len(graph[a]):
                path.append(e)
                a = to[e]
            elif path:
                a = to[path.pop() ^ 1]
                place[a] += 1
            else:
                break


def _distance(a: Element, b: Element) -> int:
    """Steps between two elements of the tree; over consecutive blocks, linear in the page."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def costs(found: list[Block], weights: tuple[float, ...]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Capacity of each block to a terminal (thousandths of log-odds, positive: content), and the smoothness edges."""
    n, gain, edges, seen = len(found), [], [], {}
    for i, b in enumerate(found):
        odds = sum(map(float.__mul__, weights, b.vector((i + 0.5) / n)))
        gain.append(round(1000 * (max(-CLIP, min(CLIP, odds)) + EVIDENCE[b.evidence])))
        if i:
            edges.append((i - 1, i, round(1000 * SMOOTH / (1 + _distance(found[i - 1].element, b.element)))))
        parent = b.element.parent
        before = seen.get(id(parent))
        if before is not None and before != i - 1:
            edges.append((before, i, round(500 * SMOOTH)))
        seen[id(parent)] = i
    return gain, edges


def label(found: list[Block], weights: tuple[float, ...]) -> list[bool]:
    """Whether each block is content."""
    return minimum_cut(*costs(found, weights))


def main_text(page: str | None, weights: tuple[float, ...] = START) -> str:
    """Content blocks in page order, joined by blank lines."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, label(found, weights), strict=True) if keep)


def _fit(x: np.ndarray, y: np.ndarray, *, steps: int = 200, rate: float = 0.3, pull: float = 0.02) -> tuple[float, ...]:
    """Logistic regression with both classes weighing the same, drawn to the starting weights."""
    start = np.array(START)
    if len(set(y.tolist())) < 2:
        return START
    w, weigh = start.copy(), np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (weigh * (p - y)) + pull * (w - start) / len(w))
    return tuple(w.tolist())


def train(pages: DataFrame, *, fit_pages: int = 1_000, fit_blocks: int = 200) -> tuple[float, ...]:
    """Classifier weights from at most ``fit_pages`` pages (of least hashed id) and ``fit_blocks`` blocks of each."""
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id")).filter("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(fit_pages)
    sample = columns(pages, page_id="long", html="string").join(F.broadcast(chosen), "page_id").select("page_id", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column(1).to_pylist():
                found = blocks(page or "")
                known = [(b.vector((i + 0.5) / len(found)), int(b.evidence == MAIN_TAG)) for i, b in enumerate(found) if b.evidence in (MAIN_TAG, AWAY_TAG)]
                rows += known[:: max(1, -(-len(known) // fit_blocks))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([list(v) for v, _ in rows], pa.list_(pa.float64())), pa.array([y for _, y in rows], pa.int32())], ["x", "y"])

    got = sample.mapInArrow(run, "x array<double>, y int").toArrow()
    if not got.num_rows:
        return START
    return _fit(np.array(got.column("x").to_pylist()), np.array(got.column("y").to_pylist()))


def extract(pages: DataFrame, weights: tuple[float, ...] = START) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return columns(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_chars long")
