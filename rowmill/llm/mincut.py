"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks of text. A logistic classifier on a block's words, links
and signs, and what the elements around it say (a menu, an article), give the cost of
taking it for content or for boilerplate: the capacities from the source and to the
sink. Blocks that follow each other, and blocks with the same parent, are joined by
smoothness edges that are weaker the further apart they are in the document tree. The
minimum cut, found by maximum flow, separates content from boilerplate. Names have a
bounded cost: against the wording of a block and all its neighbours they lose, and where
elements have no names, wording and neighbourhood alone decide.

The classifier is fitted on pages whose elements name their role.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.toxicity import _logistic

#: Pages that the classifier is fitted on at most: those with the smallest hash of their page_id.
MOST_PAGES = 1_000
#: Cost of contradicting the elements around a block, what a vague name inside the main part takes from it, bound of the
#: classifier's part, and strength of the smoothness edges, of which a block has two or more.
NAMED, VAGUE, WORDED, SMOOTH = 4.5, 4.0, 3.0, 1.0
#: Steps in the tree beyond which an edge gets no weaker.
FAR = 12

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

# How HTML elements and customary names of classes are read.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = set("iframe noembed noframes noscript script style svg template textarea title xmp".split())
CONTROLS = set("button datalist object option select".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("body div article section main ul ol dl table td th blockquote aside nav header footer form".split())
SIDE_ELEMENTS = set("aside dialog footer form header menu nav".split())
MAIN_ELEMENTS = set("article main".split())
SIDE_NAMES = set(
    "ad ads adsbygoogle advert advertisement advertising banner breadcrumb breadcrumbs contentinfo complementary consent cookie cookies copyright disclaimer footer gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion recommended related search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget".split()
)
COMMENT_NAMES = set("comment comments commentlist disqus replies reply respond discussion".split())
HEAD_NAMES = set("banner header masthead topbar".split())
MAIN_NAMES = set("article content entry main maincontent post story".split())


class _Element:
    """An element: `said` is 1 or -1 where it names itself main or side part, `vague` where only the end of a longer name does."""

    __slots__ = ("tag", "parent", "depth", "said", "soft", "vague", "comments", "holds_main", "inside_main", "evidence")

    def __init__(self, tag: str, parent: _Element | None, attributes: str):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.said, self.soft, self.vague, self.holds_main = 0, False, False, False
        self.comments = bool(parent and parent.comments)
        self.inside_main = bool(parent and (parent.inside_main or parent.tag in MAIN_ELEMENTS))
        self.evidence = 0.0
        names = []
        if attributes and tag not in ("html", "body"):
            for _, a, b, c in NAMES.findall(attributes):
                names += (a or b or c).lower().split()
        for name in names:
            parts = re.split(r"[-_]+", name)
            if parts[0] in ("has", "no", "with", "is"):
                continue
            ends = {parts[0], parts[-1], name}
            if ends & COMMENT_NAMES:
                self.said, self.comments = -1, True
            elif ends & SIDE_NAMES and self.said == 0:
                if self.inside_main and ends & SIDE_NAMES <= HEAD_NAMES:
                    pass  # the head of an article belongs to it
                elif self.inside_main and parts[0] not in SIDE_NAMES:
                    self.vague = True
                else:
                    self.said, self.soft = -1, True
            elif ends & MAIN_NAMES and self.said == 0:
                self.said = 1
        if tag == "header" and self.inside_main:
            pass
        elif tag in SIDE_ELEMENTS:
            self.said, self.soft = -1, tag == "header"
        elif tag in MAIN_ELEMENTS and self.said == 0:
            self.said = 1
        if self.said > 0 and tag in MAIN_ELEMENTS and not self.comments:
            above = parent
            while above and not above.holds_main:  # what holds the article is no side part, whatever its class
                above.holds_main = True
                if above.soft:
                    above.said = 0
                above = above.parent


def _weigh(elements: list[_Element]) -> None:
    """Evidence of each element, parents first: side parts keep theirs to the end, a vague name takes some from a main part."""
    for e in elements:
        above = e.parent.evidence if e.parent else 0.0
        if above <= -NAMED or e.said < 0:
            e.evidence = -NAMED
        elif e.vague:
            e.evidence = above - VAGUE if above > 0 else above
        else:
            e.evidence = NAMED if e.said > 0 else above


class Block:
    """A run of text without block elements inside."""

    __slots__ = ("text", "parent", "tag", "links")

    def __init__(self, text: str, parent: _Element, tag: str, links: int):
        self.text, self.parent, self.tag, self.links = text, parent, tag, links

    def named(self) -> int:
        """-1 inside a part that names itself a side part, 1 inside one that names itself the main part, else 0."""
        evidence = self.parent.evidence
        return 1 if evidence >= NAMED else -1 if evidence <= -NAMED else 0

    def features(self) -> list[float]:
        words = len(self.text.split())
        ends = self.text[-1:] in ".!?…:;\"'”’»)"
        return [math.log1p(words), self.links / len(self.text), float(ends), float(self.tag in ("p", "pre", "blockquote")), float(self.tag in ("li", "td", "th", "dd"))]


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page in order; comments, scripts, styles, titles and controls have none."""
    element = _Element("#root", None, "")
    elements, still_open = [element], Counter()
    out: list[Block] = []
    text: list[str] = []
    links = in_link = hidden = 0
    at, lower = 0, None

    def end_block() -> None:
        nonlocal text, links
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(joined, element, element.tag, min(links, len(joined))))
            text, links = [], 0

    def leave(upto: _Element) -> None:
        """Close elements from the innermost to this one."""
        nonlocal element
        while element is not upto.parent:
            still_open[element.tag] -= 1
            element = element.parent

    def add(raw: str) -> None:
        nonlocal links
        if raw and not hidden:
            raw = html.unescape(raw)
            text.append(raw)
            if in_link:
                links += len(raw.strip())

    for token in TOKEN.finditer(page):
        if token.start() < at:
            continue
        add(page[at : token.start()])
        at = token.end()
        slash, tag, attributes = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            # Foreign elements may close themselves.
            if not slash and not (tag == "svg" and attributes.endswith("/")):
                lower = lower or page.lower()
                end = lower.find(f"</{tag}", at) if len(lower) == len(page) else page.find(f"</{tag}", at)
                at = len(page) if end < 0 else end
            continue
        if tag in CONTROLS:
            hidden = max(0, hidden + (-1 if slash else 1))
            text.append(" ")
        elif tag == "a":
            in_link = 0 if slash else 1
        elif tag == "br" or tag in VOID and tag != "hr":
            text.append(" ")
        if tag in BLOCKS:
            end_block()
            hidden = in_link = 0
            if slash:
                if still_open[tag]:
                    found = element
                    while found.tag != tag:
                        found = found.parent
                    leave(found)
            else:
                while element.tag == "p":
                    leave(element)
                if tag in CLOSES and any(still_open[t] for t in CLOSES[tag]):
                    found = element
                    while found.parent and found.tag not in CLOSES[tag] and found.tag not in SCOPES:
                        found = found.parent
                    if found.tag in CLOSES[tag]:
                        leave(found)
                if tag not in VOID:
                    element = _Element(tag, element, attributes)
                    elements.append(element)
                    still_open[tag] += 1
    add(page[at:])
    end_block()
    _weigh(elements)
    return out


def _steps_apart(a: _Element, b: _Element) -> int:
    """Edges between two elements in the document tree, counted up to FAR."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node, whether it stays with the source in the smallest minimum cut.

    A positive cost is a capacity from the source, a negative one to the sink; edges
    have their capacity both ways. Maximum flow by blocking flows on level graphs.
    """
    n = len(costs)
    near: list[list[int]] = [[] for _ in range(n)]
    head: list[int] = []
    room: list[float] = []
    for a, b, capacity in edges:
        near[a].append(len(head))
        head.append(b)
        room.append(capacity)
        near[b].append(len(head))
        head.append(a)
        room.append(capacity)
    supply, demand = [max(0.0, c) for c in costs], [max(0.0, -c) for c in costs]
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if supply[i] > tiny)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            reached = reached or demand[i] > tiny
            for e in near[i]:
                if room[e] > tiny and level[head[e]] < 0:
                    level[head[e]] = level[i] + 1
                    queue.append(head[e])
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for start in range(n):
            while supply[start] > tiny and level[start] == 0:
                path: list[int] = []
                i = start
                while demand[i] <= tiny:
                    while turn[i] < len(near[i]):
                        e = near[i][turn[i]]
                        if room[e] > tiny and level[head[e]] == level[i] + 1:
                            break
                        turn[i] += 1
                    if turn[i] < len(near[i]):
                        path.append(near[i][turn[i]])
                        i = head[path[-1]]
                    elif path:
                        i = head[path.pop() ^ 1]
                        turn[i] += 1
                    else:
                        break
                if demand[i] <= tiny:
                    break
                flow = min([supply[start], demand[i], *(room[e] for e in path)])
                supply[start] -= flow
                demand[i] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def block_costs(blocks: list[Block], weights: list[float]) -> list[float]:
    """What taking each block for boilerplate costs more than taking it for content."""
    costs = []
    for block in blocks:
        guess = weights[0] + sum(w * x for w, x in zip(weights[1:], block.features()))
        costs.append(block.parent.evidence + max(-WORDED, min(WORDED, guess)))
    return costs


def label_blocks(blocks: list[Block], weights: list[float]) -> list[bool]:
    """Which blocks are content."""
    costs = block_costs(blocks, weights)
    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, SMOOTH * 0.5 ** max(0, _steps_apart(blocks[i - 1].parent, block.parent) - 2)))
        holder = block.parent.parent or block.parent
        before = last.get(id(holder))
        if before is not None and before < i - 1:
            edges.append((before, i, SMOOTH / 2))
        last[id(holder)] = i
    return minimum_cut(costs, edges)


def main_text(page: str | None, weights: list[float]) -> str:
    """The content blocks of a page, one per line; empty for a null or empty page."""
    blocks = read_blocks(page or "")
    return "\n".join(b.text for b, content in zip(blocks, label_blocks(blocks, weights)) if content)


#: For tables in which no page names its parts: long text that ends like a sentence is content, links are not.
UNTRAINED = [-2.0, 0.8, -4.0, 1.0, 0.5, -0.5]


def fit(pages: DataFrame) -> str:
    """Weights of the block classifier (JSON), fitted on blocks of a bounded number of pages whose elements name their role."""
    chosen = pages.select("page_id", "html").where("html IS NOT NULL").withColumn("h", F.xxhash64("page_id"))
    edge = chosen.select("h", "page_id").orderBy("h", "page_id").limit(MOST_PAGES)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds: dict[tuple, int] = {}
            for block in (b for page in batch.column("html").to_pylist() for b in read_blocks(page)):
                if role := block.named():  # equal blocks count together; words to a quarter of a power of e
                    x = block.features()
                    key = (round(x[0] * 4), round(x[1] * 10), *map(int, x[2:]), int(role > 0))
                    kinds[key] = kinds.get(key, 0) + 1
            yield pa.RecordBatch.from_pydict({"key": [",".join(map(str, k)) for k in kinds], "n": pa.array(list(kinds.values()), pa.int64())})

    sample = chosen.join(F.broadcast(edge.distinct()), ["h", "page_id"], "left_semi").select("html")
    # few distinct keys: words, links and three signs are all rounded
    found = sample.mapInArrow(named, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").collect()
    rows = np.array([[*map(float, r["key"].split(",")), r["n"]] for r in found]).reshape(-1, 7)
    if len(set(rows[:, 5])) < 2:
        return json.dumps(UNTRAINED)
    x = np.column_stack([rows[:, 0] / 4, rows[:, 1] / 10, rows[:, 2:5]])
    y, n = rows[:, 5], rows[:, 6]
    share = np.where(y == 1, n[y == 1].sum(), n[y == 0].sum())
    return json.dumps(_logistic(x, y, n / share * 500))


def extract_main_text(pages: DataFrame, weights: str) -> DataFrame:
    """page_id, url and text for every page; a null or empty page has an empty text. Equal rows are rows of their own, other columns are not read."""
    fitted = json.loads(weights)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(p.as_py(), fitted) for p in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(extracted, "page_id bigint, url string, text string")
