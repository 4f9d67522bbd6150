"""Main text of web pages by minimum cut.

A page becomes a graph: its text blocks, and the containers that hold them. A
classifier of a block's words, links, tag and closing mark gives its cost as
content or as boilerplate; tags, roles and class names give those of containers,
for each block that a container holds. These costs are the capacities to the two
terminals. Blocks that follow each other, and what a container holds and the
container itself, are tied by smoothness edges. One cut labels a page: a short
line of an article stays with its article, a fluent advert goes with its box.

The classifier starts from weights given here and is fitted on pages that say
themselves what is content, by an article or main element: a bounded sample of
``SAMPLE`` pages, counted by feature values where the pages are, so that only the
counts reach the driver. A weight moves by ``STEP`` at most, so that odd pages
are not judged by what is usual elsewhere.

No terminal is infinite but for what is not shown or not prose by its nature:
scripts, styles, the head, hidden elements, and forms that do not hold an article
themselves take no part.

Defined cases: null and empty pages and pages without text give an empty text;
markup that is never closed ends with its container; a raw element without an
end swallows the rest of the page, as in browsers; pages of any length are read
whole; costs of zero go to the boilerplate; repeated rows give the same text;
other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import worker_state

RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "annotation", "annotation-xml", "select", "button", "canvas", "audio", "video"))
CONTAINERS = frozenset(("html", "head", "body", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "fieldset", "ul", "ol", "dl", "li", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "blockquote", "figure", "details", "dialog", "menu"))
BLOCKS = CONTAINERS | frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "address", "dt", "dd", "figcaption", "caption", "hr", "summary", "option", "legend"))
VOID = frozenset(("hr", "br", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Containers of all content, whose names tell of the page and not of what they hold.
WHOLE = frozenset(("html", "body", "main", "article"))
#: Tags, roles and names of what is no content by its meaning.
OUTSIDE = frozenset(("nav", "footer", "aside", "dialog", "menu"))
OUTSIDE_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"))
OUTSIDE_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navigation navbar menu breadcrumb breadcrumbs footer sidebar aside widget related recommended cookie cookies consent gdpr notice banner popup modal newsletter subscribe signup login share sharing social comment comments disqus replies respond pagination pager masthead toolbar topbar".split())
#: Words that tell as much where they are only part of a name, such as comment-list.
TELLING = OUTSIDE_NAMES - frozenset("ad related recommended notice banner widget share login respond replies aside".split())
#: What follows "related" in the names of link lists.
LISTED = frozenset("posts post articles article stories links news reading content items".split())
#: Words before a name that say what a page has or lacks and not what an element is.
HAS = frozenset("has with no without show hide is".split())
INSIDE_NAMES = frozenset("article content main post entry story body text".split())

#: Tenths of a nat. Ties of blocks that follow each other, and of what a container
#: holds to it: to one that tells something by itself or by what it stands in, and
#: to any other. What is an article or outside by meaning hardly tells of what it stands in.
TIE_NEXT, TIE_PARENT, TIE_LOOSE = 8, 48, 6
#: Costs of a container for each block: outside by meaning, partly so by name, an
#: article or main element, a name of content, and what lies beside an article.
OUT, PARTLY, ARTICLE, NAMED, BESIDE = -120, -20, 90, 15, -60
#: Least and largest cost of a block by itself.
CLIP = 30

#: The classifier's features and their weights before fitting: words up to a
#: bound, share of linked characters up to a bound, closing mark, kind of tag.
WORDS, WORD_WEIGHTS = (2, 4, 8, 16, 32), (-4, 0, 3, 6, 9, 10)
LINKS, LINK_WEIGHTS = (0.25, 0.5, 0.8), (0, -8, -18, -30)
MARKS, MARK_WEIGHTS = ".!?…:;\"'”»)。！？", (0, 5)
TAGS, TAG_WEIGHTS = ("other", "text", "item", "heading"), (0, 5, -3, 4)
BASE = 12
SIZES = (len(WORD_WEIGHTS), len(LINK_WEIGHTS), len(MARK_WEIGHTS), len(TAG_WEIGHTS))
#: Form fields; words for each field, and one more, from which a form is a wrapper of text;
#: words of a notice of rights at most.
FIELDS, FIELD_WORDS, LEGAL_WORDS = frozenset(("input", "select", "textarea", "button")), 25, 20
#: Pages in the sample, and how far fitting may move a weight.
SAMPLE, STEP = 512, 3.0

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")
_UNSEEN = re.compile(r"type\s*=\s*[\"']?hidden", re.I)
#: Notices of rights, such as stand at the foot of pages without an article.
_LEGAL = re.compile(r"\W*(?:copyright\b|©|\(c\)|all rights reserved)", re.I)
_ENDS = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
_KIND = {"p": 1, "pre": 1, "blockquote": 1, "dd": 1, "li": 2, "dt": 2, "option": 2, **dict.fromkeys(HEADINGS, 3)}


def by_name(names: set[str]) -> int:
    """What class names and ids say of an element: OUT, PARTLY, NAMED or 0."""
    if names & OUTSIDE_NAMES:
        return OUT
    partly = inside = 0
    for name in names:
        words = _WORD.findall(name)
        for before, word in zip(["", *words], words):  # noqa: B905
            if word in OUTSIDE_NAMES and before not in HAS:
                if word in TELLING or (word in ("related", "recommended") and LISTED & set(words)):
                    return OUT
                partly = PARTLY
            if word in INSIDE_NAMES and before not in HAS:
                inside = NAMED
    return partly or inside


class Box:
    """A container: its parent's number, its cost for each block, what it is."""

    __slots__ = ("article", "cost", "form", "hidden", "holds", "inputs", "outside", "parent", "tag")

    def __init__(self, tag: str, parent: int, above: "Box | None"):
        self.tag, self.parent, self.cost = tag, parent, 0
        self.outside = bool(above and above.outside)
        self.hidden = bool(above and above.hidden)
        self.article = bool(above and above.article)
        self.form = self.holds = False
        self.inputs = 0


class Block:
    __slots__ = ("hidden", "linked", "own", "parent", "parts", "tag", "text")

    def __init__(self, tag: str, parent: int, own: int = 0, hidden: bool = False):
        self.tag, self.parent, self.own, self.hidden = tag, parent, own, hidden
        self.parts, self.linked, self.text = [], 0, ""


def _described(tag: str, attrs: str) -> tuple[int, bool]:
    """Cost of an element by its attributes, and whether it is hidden."""
    names: set[str] = set()
    role, hidden = 0, False
    for a in _ATTRIBUTE.finditer(attrs):
        key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
        if key in ("class", "id"):
            names.update(value.split())
        elif key == "role" and value in OUTSIDE_ROLES and tag not in WHOLE:
            role = OUT
        elif (key == "hidden" and value != "false") or (key == "aria-hidden" and value == "true") or (key == "style" and _NO_DISPLAY.search(value)):
            # Pages that scripts uncover hide their body at first.
            hidden = hidden or tag not in ("html", "body")
    if tag in WHOLE:
        return (OUT if tag == "article" and names & {"comment", "comments", "advert", "ad"} else 0), hidden
    return min(role, by_name(names)) or max(role, by_name(names)), hidden or "hidden" in names


def parsed(page: str) -> tuple[list[Block], list[Box]]:
    """Blocks that hold text and are shown, in page order, and the page's containers."""
    boxes, stack, out = [Box("", -1, None)], [0], []
    at, link = 0, False
    now = Block("", 0)

    def close() -> None:
        if now.parts and not now.hidden:
            if text := " ".join(entities.unescape("".join(now.parts)).split()):
                now.text = text
                out.append(now)

    def fresh(tag: str, own: int = 0, hidden: bool = False) -> Block:
        parent = stack[-1]
        # The heading of a header belongs to what the header stands in.
        if tag in HEADINGS:
            while boxes[parent].tag == "header" and boxes[boxes[parent].parent].article:
                parent = boxes[parent].parent
        return Block(tag, parent, own, hidden or boxes[parent].hidden)

    find = _TAG.search
    while True:
        m = find(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            now.parts.append(text)
            if link:
                now.linked += len(text)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ends = name.lower(), bool(m[1] or m[4])
        if tag in FIELDS and not ends and not _UNSEEN.search(m[3] or m[6] or ""):
            boxes[stack[-1]].inputs += 1
        # What stands in for scripts is content in an article only.
        if tag in RAW and not (tag == "noscript" and boxes[stack[-1]].article):
            if not ends and not (m[3] or m[6] or "").endswith("/"):
                e = _ENDS[tag].search(page, at)
                at = e.end() if e else len(page)
            continue
        if tag == "a":
            link = not ends
            continue
        if tag == "br":
            now.parts.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        close()
        if tag not in CONTAINERS:
            own, hidden = _described(tag, m[3] or m[6]) if not ends and (m[3] or m[6]) else (0, False)
            now = fresh("" if ends else tag, min(own, 0), hidden)
            continue
        link = False
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if boxes[stack[i]].tag == tag:
                    del stack[i:]
                    break
        elif tag != "html":
            # An item ends the item before it; so do cells and rows.
            if tag in ("li", "td", "th", "tr") and boxes[stack[-1]].tag == tag:
                stack.pop()
            above = boxes[stack[-1]]
            box = Box(tag, stack[-1], above)
            cost, hidden = _described(tag, m[3] or m[6]) if m[3] or m[6] else (0, False)
            if tag in OUTSIDE or tag == "header":
                cost = OUT
            if tag in ("article", "main") and cost != OUT and not above.outside:
                box.article, cost = True, ARTICLE
                for i in stack:
                    boxes[i].holds = True
            box.cost, box.form = cost, tag in ("form", "fieldset")
            box.outside = box.outside or cost == OUT
            box.hidden = box.hidden or hidden or tag == "head"
            stack.append(len(boxes))
            boxes.append(box)
        now = fresh("" if ends else tag)
    close()
    # Forms take no part, nor does what they hold; a form that holds an article, or has
    # many words for each of its fields, is but the page's wrapper.
    words = [0] * len(boxes)
    for b in out:
        words[b.parent] += b.text.count(" ") + 1
    for i in range(len(boxes) - 1, 0, -1):  # what a container holds comes after it
        words[boxes[i].parent] += words[i]
        boxes[boxes[i].parent].inputs += boxes[i].inputs
    for i, box in enumerate(boxes[1:], 1):
        box.form = (box.form and not box.holds and words[i] < FIELD_WORDS * (box.inputs + 1)) or boxes[box.parent].form
    for b in out:
        if _LEGAL.match(b.text) and b.text.count(" ") < LEGAL_WORDS:
            b.own = min(b.own, BESIDE)
    return [b for b in out if not boxes[b.parent].form], boxes


def features(block: Block) -> tuple[int, int, int, int]:
    n, linked = block.text.count(" ") + 1, min(1.0, block.linked / max(1, len(block.text)))
    return sum(n > x for x in WORDS), sum(linked > x for x in LINKS), int(block.text[-1] in MARKS), _KIND.get(block.tag, 0)


def labels(blocks: list[Block], boxes: list[Box]) -> list[bool | None]:
    """What the page's own structure says of each block; None on pages without an article."""
    if not boxes[0].holds:
        return [None] * len(blocks)
    return [boxes[b.parent].article and not boxes[b.parent].outside and b.own > OUT for b in blocks]


@dataclass
class Classifier:
    """Cost of a block in tenths of a nat, above 0 for content."""

    weights: tuple[np.ndarray, ...] = field(default_factory=lambda: tuple(np.array(w, float) for w in (WORD_WEIGHTS, LINK_WEIGHTS, MARK_WEIGHTS, TAG_WEIGHTS)))

    def __post_init__(self):
        self.table = BASE + sum(np.reshape(w, [-1 if i == k else 1 for i in range(len(SIZES))]) for k, w in enumerate(self.weights))
        self.table = np.clip(np.rint(self.table), -CLIP, CLIP).astype(int).tolist()

    def cost(self, block: Block) -> int:
        a, b, c, d = features(block)
        return self.table[a][b][c][d]

    @classmethod
    def fitted(cls, counts: dict[tuple[int, int, int, int], tuple[int, int]], rounds: int = 60) -> "Classifier":
        """Logistic regression on counts (boilerplate, content) of feature values,
        held near the first weights by a ridge, which each move by STEP at most."""
        start = cls()
        if not counts:
            return start
        first = np.concatenate(start.weights) / 10
        rows = np.zeros((len(counts), len(first)))
        ends = np.cumsum(SIZES) - SIZES
        n, content = np.zeros(len(counts)), np.zeros(len(counts))
        for i, (values, (no, yes)) in enumerate(sorted(counts.items())):
            rows[i, ends + np.array(values)] = 1
            n[i], content[i] = no + yes, yes
        n, content = n / n.sum(), content / n.sum()
        w, ridge = first.copy(), 0.05
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(rows @ w + BASE / 10)))
            slope = rows.T @ (n * p - content) + ridge * (w - first)
            bend = (rows * (n * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(w))
            w = np.clip(w - np.linalg.solve(bend, slope), first - STEP / 10, first + STEP / 10)
        return cls(tuple(np.split(np.round(w * 10, 3), np.cumsum(SIZES)[:-1])))


def minimum_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the content side of the minimum cut (Dinic's method).

    Where cuts tie, nodes go to the boilerplate side.
    """
    n = len(costs)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[int] = []

    def tie(a: int, b: int, there: int, back: int) -> None:
        graph[a].append(len(to))
        to.append(b)
        cap.append(there)
        graph[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            tie(s, i, c, 0)
        elif c < 0:
            tie(i, t, -c, 0)
    for a, b, w in edges:
        tie(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, [s]
        for v in queue:
            for e in graph[v]:
                if cap[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(len(costs))]
        at = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                keep = next(i for i, e in enumerate(path) if not cap[e])
                v = to[path[keep] ^ 1]
                del path[keep:]
                continue
            while at[v] < len(graph[v]):
                e = graph[v][at[v]]
                if cap[e] > 0 and level[to[e]] == level[v] + 1:
                    break
                at[v] += 1
            else:
                if v == s:
                    break
                level[v] = -1
                v = to[path.pop() ^ 1]
                continue
            path.append(e)
            v = to[e]


@dataclass
class Graph:
    """Blocks come first, then the containers that tie more than one thing or have a cost."""

    costs: list[int]
    edges: list[tuple[int, int, int]]
    blocks: int


def graph_of(blocks: list[Block], boxes: list[Box], classifier: Classifier) -> Graph:
    costs = [classifier.cost(b) + b.own for b in blocks]
    edges = [(i, i + 1, TIE_NEXT) for i in range(len(blocks) - 1)]
    held, inner = [0] * len(boxes), [0] * len(boxes)  # blocks below each container; those inside an article
    children = [0] * len(boxes)
    for b in blocks:
        inside = boxes[b.parent].article
        i = b.parent
        children[i] += 1
        while i >= 0:
            held[i] += 1
            inner[i] += inside
            i = boxes[i].parent
    used = [i for i, box in enumerate(boxes) if held[i]]
    for i in used:
        if boxes[i].parent >= 0:
            children[boxes[i].parent] += 1
    told = [0] * len(boxes)  # what a container costs for each block, by itself or by what it stands in
    for i in used:
        box = boxes[i]
        # An article in a main element tells better than that does; beside one there is little else to read.
        if box.parent < 0:
            told[i] = BESIDE if box.holds else 0
        else:
            told[i] = NAMED if box.tag == "main" and box.cost == ARTICLE and box.holds else box.cost or told[box.parent]
    node: dict[int, int] = {}
    for i in used:
        box = boxes[i]
        if box.parent < 0 or children[i] > 1 or box.cost:
            node[i] = len(costs)
            costs.append(told[i] * (held[i] - inner[i] if box.holds and not box.article else held[i]))

    def tie(parent: int, blocks: int) -> tuple[int, int]:
        while parent not in node:
            parent = boxes[parent].parent
        return node[parent], blocks * (TIE_PARENT if told[parent] else TIE_LOOSE)

    edges += [(k, *tie(b.parent, 1)) for k, b in enumerate(blocks)]
    for i, k in node.items():
        if boxes[i].parent >= 0:
            top, weight = tie(boxes[i].parent, held[i])
            edges.append((k, top, TIE_NEXT if boxes[i].cost in (OUT, ARTICLE) else weight))
    return Graph(costs, edges, len(blocks))


def labelled(page: str | None, classifier: Classifier) -> tuple[list[Block], list[bool], list[bool]]:
    """The page's blocks, whether each is content by the cut, and whether by its own cost."""
    blocks, boxes = parsed(page) if page else ([], [])
    if not blocks:
        return [], [], []
    g = graph_of(blocks, boxes, classifier)
    return blocks, minimum_cut(g.costs, g.edges)[: g.blocks], [c > 0 for c in g.costs[: g.blocks]]


def main_text(page: str | None, classifier: Classifier | None = None) -> str:
    blocks, content, _ = labelled(page, classifier or Classifier())
    return "\n".join(b.text for b, yes in zip(blocks, content, strict=True) if yes)


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Classifier:
    """A classifier fitted on the pages of least hash in each of ``sample`` buckets of ids.

    The hashes are found by a sum over all rows, the features are counted where
    the pages are; a row for each combination of values reaches the driver."""
    h = F.xxhash64(id_col)
    least = [r["h"] for r in pages.groupBy(F.pmod(h, F.lit(sample)).alias("b")).agg(F.min(h).alias("h")).collect()]
    if not least:
        return Classifier()

    def run(batches):
        for batch in batches:
            found: Counter = Counter()
            for page in batch.column(0):
                if text := page.as_py():
                    blocks, boxes = parsed(text)
                    found.update((*features(b), label) for b, label in zip(blocks, labels(blocks, boxes), strict=True) if label is not None)
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = [pa.int32()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(list(found.values()), pa.int64())], names=["a", "b", "c", "d", "label", "n"])

    got = pages.where(h.isin(least)).select(html_col).mapInArrow(run, "a int, b int, c int, d int, label boolean, n long")
    counts: dict[tuple[int, int, int, int], tuple[int, int]] = {}
    for r in got.groupBy("a", "b", "c", "d", "label").agg(F.sum("n").alias("n")).collect():
        no, yes = counts.get(key := (r["a"], r["b"], r["c"], r["d"]), (0, 0))
        counts[key] = (no, yes + r["n"]) if r["label"] else (no + r["n"], yes)
    return Classifier.fitted(counts)


def extract(pages: DataFrame, classifier: Classifier | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row, and how many blocks it has, how many
    are content and how many the cut labels otherwise than their own cost; no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(classifier or Classifier())

    def run(batches):
        worker_state("html", bool)  # lets go of other operators' memos
        for batch in batches:
            rows = []
            for page in batch.column(2):
                blocks, content, alone = labelled(page.as_py(), shared.value)
                text = "\n".join(b.text for b, yes in zip(blocks, content, strict=True) if yes)
                rows.append((text, len(text), len(blocks), sum(content), sum(a != b for a, b in zip(content, alone, strict=True))))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_content", "n_changed"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_content long, n_changed long")
