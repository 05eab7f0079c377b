"""Main-text extraction with a tree-structured graphical model over the DOM.

Every block-level element and every text block has a binary variable: content or
not. Node potentials are log-linear in features of tag, class and id words, text
length and link share; edge potentials couple a node with its parent. The graph
is a tree, so one sum-product pass upward and one downward give exact marginals.
The weights maximise the likelihood of labelled pages. A text block is kept when
its marginal says content.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import slices
from lumenfold.llm.dom import Dom, blocks, parse
from lumenfold.llm.labelled_pages import LABEL, pages as labelled_pages

#: Pages of the labelled collection (composed, see labelled_pages) that the model is fitted on.
TRAINING_PAGES = 240
ROUNDS = 80
STEP = 1.0
RIDGE = 1e-3
KEEP_FROM = 0.5
_WORD = re.compile(r"[a-z]+")
#: Elements that say what kind of part they are; the nearest one above a text is a feature of it.
SECTIONS = frozenset("nav aside footer header form article main dialog".split())


class Tree:
    """Variables of one page: ``parent`` (parents first), ``features`` and, for text blocks, ``text``."""

    __slots__ = ("parent", "features", "text", "element")

    def __init__(self):
        self.parent, self.features, self.text, self.element = [], [], [], []

    def add(self, parent: int, features: list[str], text: str | None, element: int) -> int:
        self.parent.append(parent), self.features.append(features), self.text.append(text), self.element.append(element)
        return len(self.parent) - 1


def _element_features(dom: Dom, i: int) -> list[str]:
    found = [f"tag:{dom.tag[i]}"]
    if dom.names[i]:
        found += [f"name:{w}" for w in dict.fromkeys(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", dom.names[i]).lower()))]
    return found


def tree_of(dom: Dom) -> Tree:
    """The model's variables: the block elements above text, and below them the text blocks."""
    tree, number, around = Tree(), {}, {-1: "body"}
    for i, text, linked in blocks(dom):
        path, up = [], i
        while up >= 0 and up not in number:  # each element is taken once, so this is linear
            path.append(up)
            up = dom.parent[up]
        for k in reversed(path):
            number[k] = tree.add(number[up] if up >= 0 else -1, _element_features(dom, k), None, k)
            around[k] = dom.tag[k] if dom.tag[k] in SECTIONS else f"named {dom.tag[k]}" if dom.names[k] else around[up]
            up = k
        inside = "body" if dom.tag[i] == "#root" else dom.tag[i]  # a page need not have a body's tag
        share = min(3, 4 * linked // (len(text) + 1))
        length = min(6, (text.count(" ") + 1).bit_length())
        tree.add(number[i], [
            "text", f"in:{inside}", f"in:{inside}&links:{share}", f"under:{around[i]}", f"under:{around[i]}&links:{share}", f"length:{length}", f"links:{share}", f"links:{share}&length:{length >= 4}",
            "end:stop" if text[-1] in ".!?:;\"'”»…" else "end:none",
        ], text, i)
    return tree


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def marginals(parent: list[int], node: list[float], edge: tuple[float, float]) -> tuple[list[float], list[float], list[float]]:
    """Per node P(content), P(alike with its parent) and P(content like its parent); the last two are 0 at the root.

    ``node`` are log odds of content; ``edge`` the log potentials of equal and
    of content-content pairs. One pass goes upward, one downward.
    """
    n = len(parent)
    alike, both = edge
    up0, up1 = [0.0] * n, list(node)
    to_parent0, to_parent1 = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):  # children come after their parents
        to_parent0[i] = _add(up0[i] + alike, up1[i])
        to_parent1[i] = _add(up0[i], up1[i] + alike + both)
        if parent[i] >= 0:
            up0[parent[i]] += to_parent0[i]
            up1[parent[i]] += to_parent1[i]
    out, equal, pair, all0, all1 = [0.0] * n, [0.0] * n, [0.0] * n, list(up0), list(up1)
    for i in range(n):
        p = parent[i]
        if p >= 0:
            rest0, rest1 = all0[p] - to_parent0[i], all1[p] - to_parent1[i]
            top = max(rest0, rest1)
            rest0, rest1 = rest0 - top, rest1 - top
            all0[i] = up0[i] + _add(rest0 + alike, rest1)
            all1[i] = up1[i] + _add(rest0, rest1 + alike + both)
            total = _add(all0[i], all1[i])
            pair[i] = math.exp(rest1 + up1[i] + alike + both - total)
            equal[i] = pair[i] + math.exp(rest0 + up0[i] + alike - total)
        out[i] = 1 / (1 + math.exp(max(-700.0, min(700.0, all0[i] - all1[i]))))
    return out, equal, pair


class Model:
    def __init__(self):
        self.weights: dict[str, float] = {}
        self.edge = (0.5, 0.0)

    def odds(self, tree: Tree) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in features) for features in tree.features]

    def content(self, page: str) -> list[str]:
        """The page's content blocks, in order."""
        tree = tree_of(parse(page))
        if not tree.parent:
            return []
        p, _, _ = marginals(tree.parent, self.odds(tree), self.edge)
        return [text for text, q in zip(tree.text, p, strict=True) if text is not None and q >= KEEP_FROM]


def _labels(dom: Dom, tree: Tree) -> list[int]:
    """1 for content, from the nearest marked element at or above each node."""
    mark = [0] * len(dom.tag)
    for i in range(1, len(dom.tag)):
        mark[i] = int(dom.mark[i]) if dom.mark[i] else mark[dom.parent[i]]
    return [mark[i] for i in tree.element]


def train(pages: list[str]) -> Model:
    """Fit by gradient steps on the exact likelihood: observed less expected features, by sum-product."""
    data = []
    for page in pages:
        dom = parse(page, LABEL)
        tree = tree_of(dom)
        data.append((tree, _labels(dom, tree)))
    model = Model()
    squares: dict[str, float] = defaultdict(lambda: 1e-8)
    edge, edge_squares = [0.5, 0.0], [1e-8, 1e-8]
    for _ in range(ROUNDS):
        slope: dict[str, float] = defaultdict(float)
        edge_slope = [0.0, 0.0]
        model.edge = tuple(edge)
        for tree, labels in data:
            p, equal, pair = marginals(tree.parent, model.odds(tree), model.edge)
            for i, (features, y, q) in enumerate(zip(tree.features, labels, p, strict=True)):
                for f in features:
                    slope[f] += y - q
                if (up := tree.parent[i]) >= 0:
                    edge_slope[0] += (y == labels[up]) - equal[i]
                    edge_slope[1] += y * labels[up] - pair[i]
        for f, g in slope.items():
            g -= RIDGE * len(data) * model.weights.get(f, 0.0)
            squares[f] += g * g
            model.weights[f] = model.weights.get(f, 0.0) + STEP * g / math.sqrt(squares[f])
        for k in range(2):
            edge_squares[k] += edge_slope[k] ** 2
            edge[k] = min(3.0, max(0.0 if k else 0.3, edge[k] + 0.2 * edge_slope[k] / math.sqrt(edge_squares[k])))
    model.edge = tuple(edge)
    return model


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Blocks are joined by two line feeds. A null or empty page, or one without
    content, has an empty text. Rows are independent; repeated ones get equal
    results. Other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages(TRAINING_PAGES)))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = ["\n\n".join(shared.value.content(h)) if h else "" for h in part.column(2).to_numpy(zero_copy_only=False)]
            yield pa.record_batch(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
