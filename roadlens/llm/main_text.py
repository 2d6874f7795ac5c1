"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes its text blocks in page order. A logistic classifier gives each block a
cost for either label; the costs are the capacities to the two terminals. Neighbouring
blocks are joined by smoothness edges, the stronger the more of their DOM path they
share, and so are blocks that follow each other under one parent. A maximum flow finds the
cheapest cut between content and boilerplate.

The classifier is trained on the pages themselves: blocks in containers whose role is
stated (article, navigation, footer, ...) label the shapes of blocks (length, links,
punctuation, tag). Shapes fall into few classes, so training needs their counts only. They come
from about ``FIT_PAGES`` pages, chosen by a hash, or all if there are fewer. Stated roles enter the costs as well. The innermost statement counts: an article
in a form or in a wrapper whose class names a sidebar is content, a comment section in an
article is not. Single words within longer class names, and forms, only add a small cost that
classifier and edges can outvote. Inline elements stay in their paragraph.

Large open graphs are reduced before the flow: a block with at most two open neighbours is
minimised out, which leaves an equal cut problem on the others. Blocks of a page and their
edges (neighbours, and blocks under one parent) nest like brackets, so they reduce wholly and
time grows with the page.

A null or empty page has the empty text. Character references are decoded, white space in a
block becomes one space, blocks are joined by one newline; nothing else is dropped or cut.
Rows are independent, repeated ones give repeated results."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.storage import let_workers_import

# Fixed lists: elements by kind, words in class names and ids, roles.
SKIPPED = frozenset("script style template head title select textarea option datalist".split())
FALLBACK = frozenset("noscript iframe object canvas audio video svg".split())  # content only inside an article
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
LINES = frozenset("p li dd dt td th h1 h2 h3 h4 h5 h6 figcaption blockquote pre summary".split())
CONTROLS = frozenset("button label".split())  # of their own only where no line of text holds them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AGAINST_TAGS = frozenset("nav footer aside menu dialog".split())
AGAINST_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar side aside "
    "rail widget widgets share sharing social ad ads adv advert adverts advertisement "
    "advertising banner promo sponsor sponsored cookie cookies consent gdpr notice notices alert newsletter "
    "subscribe subscription popup modal overlay login signin signup search searchbox "
    "pagination pager skip hidden".split())
OTHERS_WORDS = frozenset("comment comments reply replies respond disqus related recommended".split())
AGAINST_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu "
                          "menubar toolbar".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BORDERS = frozenset("ul ol dl table tbody thead tfoot body html article section div nav aside".split())

STATING = FALLBACK | AGAINST_TAGS | {"header", "article", "main", "form"}

# Costs of statements: an article; other people's words and page furniture; a container named
# as such; a word within a longer name, or a form (at most so much together); a first heading.
STATED_FOR, STATED_AGAINST, NAMED, HINT, MOST_HINTS, TITLE = 6.0, -8.0, -5.0, -1.0, -3.0, 3.0
SMOOTH = 1.0
FIT_PAGES = 20_000  # pages the classifier is fitted on
LARGE = 512  # open blocks above which a graph is reduced before the flow
LENGTHS = (0, 15, 40, 80, 160, 320)
LINKS = (0.0, 0.2, 0.5)
TAGS = ("p", "li", "heading", "cell", "other")


class Block(NamedTuple):
    """A block of a page: text, share of linked characters, tag, number of open block elements,
    how many of them it shares with the block before, its parent's number, stated cost."""

    text: str
    links: float
    tag: str
    depth: int
    shared: int
    parent: int
    cost: float

    @property
    def role(self) -> int:
        return 1 if self.cost >= STATED_FOR + MOST_HINTS else -1 if self.cost <= NAMED else 0


class _Open:
    """An open element and what it hands down: block elements on the path, their numbers, the
    innermost block's tag and the stated cost."""

    __slots__ = ("tag", "block", "depth", "number", "parent", "inner", "cost", "skips", "apart")

    def __init__(self, tag, block, depth, number, parent, inner, cost, skips, apart):
        self.tag, self.block, self.depth, self.number, self.parent = tag, block, depth, number, parent
        self.inner, self.cost, self.skips, self.apart = inner, cost, skips, apart


class _Page(HTMLParser):
    """The blocks of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Open("body", False, 0, 0, 0, "body", 0.0, False, False)
        self.stack: list[_Open] = []
        self.count: Counter = Counter()  # open elements by tag
        self.lines: list[int] = []  # places of open p elements
        self.borders: list[int] = []
        self.blocks: list[Block] = []
        self.words: list[str] = []
        self.linked = self.elements = self.skipping = self.in_links = self.low = self.titles = 0

    @property
    def top(self) -> _Open:
        return self.stack[-1] if self.stack else self.root

    def _flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            top = self.top
            cost = top.cost
            if top.inner == "h1" and cost > NAMED and not self.titles:
                cost, self.titles = cost + TITLE, 1
            self.blocks.append(Block(text, min(1.0, self.linked / len(text)), top.inner, top.depth,
                                     min(self.low, top.depth), top.parent, cost))
            self.low = top.depth
        self.words, self.linked = [], 0

    def _pop(self, to: int) -> None:
        for element in self.stack[to:]:
            self.count[element.tag] -= 1
            self.skipping -= element.skips
            self.in_links -= element.tag == "a"
        del self.stack[to:]
        for places in (self.lines, self.borders):
            while places and places[-1] >= to:
                places.pop()
        self.low = min(self.low, self.top.depth)

    def _stated(self, tag: str, attributes, block: bool) -> tuple[float, bool]:
        """The cost handed down by an element, and whether it is hidden."""
        cost = self.top.cost
        if tag not in STATING and (not attributes or tag == "a" and len(attributes) == 1 and attributes[0][0] == "href"):
            return cost, False
        of = {k: (v or "").lower() for k, v in attributes}
        hidden = ("hidden" in of or of.get("aria-hidden") == "true"
                  or "display:none" in of.get("style", "").replace(" ", ""))
        if tag in FALLBACK:
            return (cost if cost > 0 else min(cost, NAMED)), hidden
        if not block:
            return cost, hidden
        if hidden or tag in AGAINST_TAGS or of.get("role") in AGAINST_ROLES:
            return STATED_AGAINST, False
        if tag == "header":  # the heading of an article is a part of it
            return (cost if cost > 0 else STATED_AGAINST), False
        names = (of.get("class", "") + " " + of.get("id", "")).split()
        words = set(" ".join(names).replace("-", " ").replace("_", " ").split())
        whole = tag not in ("html", "body")
        if whole and (words & OTHERS_WORDS or tag in ("article", "main") and words & {"ad", "ads"}):
            return STATED_AGAINST, False
        if tag in ("article", "main") or of.get("role") == "main":
            return (STATED_FOR if cost > STATED_AGAINST else cost), False
        if cost <= NAMED:
            return cost, False
        if whole and AGAINST_WORDS.intersection(names):
            return NAMED, False
        if whole and words & AGAINST_WORDS or tag == "form":
            least = (STATED_FOR if cost > 0 else 0.0) + MOST_HINTS
            return max(least, cost + HINT), False
        return cost, False

    def handle_starttag(self, tag, attributes) -> None:
        block = tag in BLOCKS
        if block:
            self._flush()
            if self.lines and not (self.borders and self.borders[-1] > self.lines[-1]):
                self._pop(self.lines[-1])
            closes = SIBLINGS.get(tag)
            if closes and any(self.count[t] for t in closes):
                for at in range(len(self.stack) - 1, -1, -1):
                    if self.stack[at].tag in closes:
                        self._pop(at)
                        break
                    if self.stack[at].tag in BORDERS:
                        break
        if tag == "br":
            self.words.append(" ")
        if tag in VOID:
            return
        top = self.top
        cost, hidden = self._stated(tag, attributes, block)
        apart = tag in CONTROLS and top.inner not in LINES or tag in FALLBACK and cost <= NAMED
        if apart:
            self._flush()
            cost = min(cost, NAMED)
        self.elements += 1
        skips = tag in SKIPPED or hidden
        self.stack.append(_Open(
            tag, block, top.depth + block, self.elements if block else top.number,
            top.number if block else top.parent, tag if block else top.inner, cost, skips, apart))
        if block and tag == "p":
            self.lines.append(len(self.stack) - 1)
        if tag in BORDERS:
            self.borders.append(len(self.stack) - 1)
        self.count[tag] += 1
        self.skipping += skips
        self.in_links += tag == "a"

    def handle_startendtag(self, tag, attributes) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        if not self.count[tag]:
            return
        for at in range(len(self.stack) - 1, -1, -1):
            element = self.stack[at]
            if element.tag == tag:
                if self.stack[-1].depth > (self.stack[at - 1].depth if at else 0) or any(
                        x.apart for x in self.stack[at:]):
                    self._flush()
                self._pop(at)
                return
            if tag not in BLOCKS and element.block:
                return  # an inline end tag does not leave its block

    def handle_data(self, data) -> None:
        if not self.skipping:
            self.words.append(data)
            if self.in_links:
                self.linked += len(data)


def blocks(html: str | None):
    page = _Page()
    page.feed(html or "")
    page.close()
    page._flush()
    return page.blocks


def shape(text: str, links: float, tag: str) -> tuple[int, int, int, int, int]:
    kind = "heading" if tag[0] == "h" and tag[1:].isdigit() else "cell" if tag in ("td", "th") else tag
    return (sum(len(text) > x for x in LENGTHS[1:]), sum(links > x for x in LINKS),
            int(text[-1] in ".!?…\"»”"), int("," in text),
            TAGS.index(kind) if kind in TAGS else len(TAGS) - 1)


def _vector(s: tuple[int, int, int, int, int]) -> list[float]:
    return [1.0, *(float(s[0] == i) for i in range(len(LENGTHS))), *(float(s[1] == i) for i in range(len(LINKS) + 1)),
            float(s[2]), float(s[3]), *(float(s[4] == i) for i in range(len(TAGS)))]


def train(counts: list[tuple[tuple, int, int]]) -> dict[tuple, float]:
    """Log-odds of content per block shape, from counted ``(shape, label, blocks)``."""
    width = len(_vector((0, 0, 0, 0, 0)))
    prior = np.zeros(width)
    prior[1:1 + len(LENGTHS)] = np.linspace(-1.5, 2.0, len(LENGTHS))
    prior[1 + len(LENGTHS):][: len(LINKS) + 1] = (0.3, 0.0, -1.0, -2.5)
    prior[2 + len(LENGTHS) + len(LINKS):][:2] = (0.7, 0.5)
    weights = prior.copy()
    if counts:
        x = np.array([_vector(s) for s, _, _ in counts])
        y = np.array([label for _, label, _ in counts], float)
        n = np.array([c for *_, c in counts], float)
        n *= min(1.0, 1000 / n.sum())
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(width),
                                   x.T @ (n * (p - y)) + weights - prior)
            weights = weights - step
    shapes = [(a, b, c, d, e) for a in range(len(LENGTHS)) for b in range(len(LINKS) + 1)
              for c in (0, 1) for d in (0, 1) for e in range(len(TAGS))]
    return {s: float(np.clip(np.dot(_vector(s), weights), -4, 4)) for s in shapes}


def edges(found: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness between neighbours and between a block and the one before it under its parent.
    It is weak across the border of a container with a stated role."""
    out: dict[tuple[int, int], float] = {}
    under: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            before = found[i - 1]
            near = 0.2 + 0.8 * block.shared / max(before.depth, block.depth, 1)
            out[i - 1, i] = SMOOTH * near * (1.0 if block.role == before.role else 0.2)
        earlier = under.get(block.parent)
        if earlier is not None and earlier != i - 1:
            out[earlier, i] = SMOOTH / 2 * (1.0 if block.role == found[earlier].role else 0.2)
        under[block.parent] = i
    return out


def _reduced(costs: dict[int, float], near: list[dict[int, float]]) -> dict[int, bool] | None:
    """The minimum cut of a graph by minimising out one node after another, each with at most
    two neighbours; None if some nodes have more at the end.

    What two neighbours pay for a node that is gone is a table over their labels."""
    own = {i: [max(c, 0.0), max(-c, 0.0)] for i, c in costs.items()}  # paid for labels 0 and 1
    pair: dict[int, dict[int, list[list[float]]]] = {i: {} for i in costs}
    for i in costs:
        for j, w in near[i].items():
            pair[i][j] = [[0.0, w], [w, 0.0]]
    gone: list[tuple] = []
    waiting = [i for i in costs if len(pair[i]) <= 2]
    left = set(costs)
    while waiting:
        i = waiting.pop()
        if i not in left or len(pair[i]) > 2:
            continue
        left.discard(i)
        around = list(pair[i].items())
        gone.append((i, own[i], around))
        for j, _ in around:
            del pair[j][i]
        if len(around) == 1:
            (j, of_j), = around
            for x in (0, 1):
                own[j][x] += min(own[i][y] + of_j[y][x] for y in (0, 1))
        elif len(around) == 2:
            (j, of_j), (k, of_k) = around
            table = [[min(own[i][y] + of_j[y][x] + of_k[y][z] for y in (0, 1)) for z in (0, 1)] for x in (0, 1)]
            had = pair[j].get(k)
            if had is not None:
                table = [[table[x][z] + had[x][z] for z in (0, 1)] for x in (0, 1)]
            pair[j][k] = table
            pair[k][j] = [[table[x][z] for x in (0, 1)] for z in (0, 1)]
        waiting += [j for j, _ in around if len(pair[j]) <= 2]
    if left:
        return None
    label: dict[int, int] = {}
    for i, paid, around in reversed(gone):
        price = [paid[y] + sum(table[y][label[j]] for j, table in around) for y in (0, 1)]
        label[i] = int(price[1] < price[0])
    return {i: bool(x) for i, x in label.items()}


def cut(costs: list[float], smooth: dict[tuple[int, int], float]) -> list[bool]:
    """Blocks on the content side of the minimum cut. ``costs`` above zero speak for content.

    A block whose own cost outweighs all its edges is decided at once and pulls its
    neighbours; what stays open is separated by a maximum flow (shortest augmenting paths)."""
    n = len(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in smooth.items():
        near[a][b] = near[b][a] = w
    cost, label = list(costs), [None] * n
    waiting = deque(range(n))
    while waiting:
        i = waiting.popleft()
        if label[i] is not None or abs(cost[i]) < sum(near[i].values()):
            continue
        label[i] = cost[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            cost[j] += w if label[i] else -w
            waiting.append(j)
    open_ = [i for i in range(n) if label[i] is None]
    reduced = _reduced({i: cost[i] for i in open_}, near) if len(open_) > LARGE else None
    if reduced is not None:
        for i, kept in reduced.items():
            label[i] = kept
    elif open_:
        source, sink = -1, -2
        room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in open_}
        room[source], room[sink] = {}, {}
        for i in open_:
            if cost[i] > 0:
                room[source][i] = cost[i]
                room[i][source] = 0.0
            else:
                room[i][sink] = -cost[i]
                room[sink][i] = 0.0
        while True:
            came, queue = {source: source}, deque([source])
            while queue and sink not in came:
                i = queue.popleft()
                for j, r in room[i].items():
                    if r > 1e-12 and j not in came:
                        came[j] = i
                        queue.append(j)
            if sink not in came:
                break
            path, j = [], sink
            while j != source:
                path.append((came[j], j))
                j = came[j]
            flow = min(room[a][b] for a, b in path)
            for a, b in path:
                room[a][b] -= flow
                room[b][a] = room[b].get(a, 0.0) + flow
        for i in open_:
            label[i] = i in came
    return label


def extract(html: str | None, odds: dict[tuple, float]) -> tuple[str, int, int]:
    """Main text, number of blocks, number of content blocks."""
    found = blocks(html)
    costs = [odds[shape(b.text, b.links, b.tag)] + b.cost for b in found]
    keep = cut(costs, edges(found))
    text = [b.text for b, k in zip(found, keep, strict=True) if k]
    return "\n".join(text), len(found), len(text)


def learned(df: DataFrame, html: str = "html", fit_pages: int = FIT_PAGES) -> dict[tuple, float]:
    """The classifier, trained on the shapes of blocks with a stated role of about ``fit_pages``
    pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                for block in blocks(page.as_py()):
                    if block.role:
                        counts[(*shape(block.text, block.links, block.tag), int(block.role > 0))] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in keys], pa.int32()) for i in range(6)),
             pa.array([counts[k] for k in keys], pa.int64())], names=["a", "b", "c", "d", "e", "label", "n"])

    let_workers_import(df.sparkSession)
    pages = df.select(html)
    count = pages.count()
    if count > fit_pages:
        pages = pages.where(F.pmod(F.xxhash64(html), F.lit(1 << 20)) < (fit_pages << 20) // count)
    rows = (pages.mapInArrow(run, "a int, b int, c int, d int, e int, label int, n long")
            .groupBy("a", "b", "c", "d", "e", "label").agg(F.sum("n").alias("n")).collect())
    return train(sorted((tuple(r[:5]), r[5], r[6]) for r in rows))


def main_text(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` without its html, with ``text``, ``n_chars``, ``n_blocks`` and ``n_content``."""
    odds = learned(df, html)
    rest = [c for c in df.columns if c not in (html, "text", "n_chars", "n_blocks", "n_content")]
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [extract(p.as_py(), odds) for p in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([f[0] for f in found], pa.string()),
                     pa.array([len(f[0]) for f in found], pa.int64()),
                     pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())],
                    names=[*rest, "text", "n_chars", "n_blocks", "n_content"])

    return df.select(*rest, html).mapInArrow(
        run, ", ".join([*fields, "text string, n_chars long, n_blocks long, n_content long"]))
