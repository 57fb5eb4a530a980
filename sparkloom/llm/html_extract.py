"""Main-text extraction with a tree-structured graphical model.

A page becomes the tree of its block elements; inline markup melts into the block around it, elements
without any text go, and one that holds nothing but another is merged with it, so that the depth of the
markup does not weigh. Each node has a binary label, content or not. Its own evidence (tag, class and id words, length and link share of
its text) is a log-linear potential, and each parent-child edge has one that depends on the child's kind and on
whether the parent is a frame (the page, or a block with sections in it, which may hold anything).
Messages from the leaves to the root and back give every node's exact marginal; text of nodes whose
marginal exceeds a half is the main text. Weights maximise the likelihood of the labelled pages, whose
gradient needs the same messages.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*)|[^>]*+)(?:>|\Z))",
    re.S,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr nobr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame keygen".split())
_RAW = frozenset("script style textarea title iframe noframes xmp".split())  # no markup inside
_TO_END = frozenset("script style".split())  # left open, they reach to the end of the page
_SKIPPED = frozenset("noscript template svg math object select button canvas audio video".split())  # markup inside, no main text
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul tr td th".split())
_SIBLING = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NAMES = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PIECE = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]+")
_SPACE = re.compile(r"\s+")

HASHED = 1 << 12  # weights of tags and names
SHAPES = 40  # weights of text shapes
KINDS = 6  # kinds of an edge: child sectioning, named or plain, below a block or a frame
_FRAMES = frozenset("#page html body".split())
_PARTS = frozenset("article main aside footer header section".split())  # what holds one is a frame
_ASIDE = frozenset("header footer nav aside form".split())  # never frames
_SECTIONS = frozenset("article main nav aside footer header section form".split())


def _slot(name: str) -> int:
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % HASHED


@lru_cache(maxsize=1 << 14)
def _look(tag: str, attrs: str) -> tuple[tuple[int, ...], tuple[int, ...], int]:
    """Features of a tag with its attributes; those that stay if it is merged with the one element in it;
    its kind."""
    names = set()
    for m in _NAMES.finditer(attrs):
        for whole in (m[1] or m[2] or m[3] or "").lower().replace("_", "-").split():
            names.add(whole)
            names |= {x for x in _PIECE.findall(whole) if len(x) > 1}
    kind = 0 if tag in _SECTIONS else 1 if names else 2
    kept = {_slot(x) for x in names} | ({_slot("<" + tag)} if kind == 0 else set())
    return tuple(sorted(kept | {_slot("<" + tag)})), tuple(sorted(kept)), kind


def _skipped_ends(page: str, tag: str) -> dict[int, int]:
    """End of each element of that tag, by the place after its start tag. Those left open have none."""
    ends, opened = {}, []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*>", page, re.I):
        if not m[1]:
            if not m[0].endswith("/>"):
                opened.append(m.end())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends


def _crosses(page: str, at: int, end: int, opened: Counter) -> bool:
    """Whether the markup in page[at:end] closes an element that was open before."""
    inside: Counter = Counter()
    for m in _TAG.finditer(page, at, end):
        if m[2] is None or (tag := m[2].lower()) in _INLINE or tag in _VOID or tag == "p":
            continue
        if not m[1]:
            inside[tag] += 1
        elif inside[tag]:
            inside[tag] -= 1
        elif opened[tag]:
            return True
    return False


def parse(page: str):
    """Tree of block elements in page order: (parent, tag, attributes, words of own text, linked words)
    for each node, and the text runs (node, text) in page order. Unknown or unclosed markup never fails.
    A skipped element that is left open, or that other markup closes, ends with its start tag."""
    nodes = [[-1, "#page", "", 0, 0]]
    runs: list[tuple[int, list[str]]] = []
    stack: list[int] = [0]  # open blocks
    inline: list[str] = []
    links, at, n = 0, 0, len(page)
    current: list[str] = []
    opened: Counter = Counter()  # open blocks by tag
    ends: dict[str, dict[int, int]] = {}  # of skipped elements, by tag
    endless: set[str] = set()  # raw elements that nothing closes from here on

    def leave(i: int):
        for x in stack[i:]:
            opened[nodes[x][1]] -= 1
        del stack[i:]

    def close_run():
        nonlocal current
        if current:
            runs.append((stack[-1], current))
            current = []

    def text(part: str):
        current.append(part)
        words = len(part.split())
        nodes[stack[-1]][3] += words
        if links:
            nodes[stack[-1]][4] += words

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:  # closing
            if tag in _INLINE:
                if tag == "a" and links:
                    links -= 1
                continue
            if opened[tag]:
                i = len(stack) - 1
                while nodes[stack[i]][1] != tag:
                    i -= 1
                close_run()
                leave(i)
                links = 0
            elif tag in ("p", "br"):
                close_run()
            continue
        if tag in _RAW:
            if not m[3].endswith("/") and tag not in endless:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in _TO_END:
                    at = n
                else:
                    endless.add(tag)
            current.append(" ") if current else None
            continue
        if tag in _SKIPPED:
            if tag not in ends:
                ends[tag] = _skipped_ends(page, tag)
            end = ends[tag].get(at)
            if end and not _crosses(page, at, end, opened):
                at = end
            current.append(" ") if current else None
            continue
        if tag in _INLINE:
            links += tag == "a"
            continue
        if tag in ("br", "hr") or tag in _VOID:
            if tag == "hr":
                close_run()
            elif current:
                current.append(" ") if tag == "br" else None
            continue
        close_run()
        links = 0
        if tag in _CLOSES_P and nodes[stack[-1]][1] == "p":
            leave(len(stack) - 1)
        if tag in _SIBLING and any(opened[x] for x in _SIBLING[tag][0]):
            closed, stops = _SIBLING[tag]
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]][1] in stops:
                    break
                if nodes[stack[i]][1] in closed:
                    leave(i)
                    break
        if tag in ("html", "body") and opened[tag]:
            continue
        nodes.append([stack[-1], tag, m[3], 0, 0])
        if not m[3].endswith("/"):
            stack.append(len(nodes) - 1)
            opened[tag] += 1
    close_run()
    return nodes, runs


class Tree:
    """The nodes that the model sees. places: their numbers among all nodes, -1 for those without text and
    those merged into the one below; then parents, features, and kinds of edges."""

    def __init__(self, nodes):
        total = _below(nodes)
        held = [0] * len(nodes)  # children with text
        frame = [x[1] in _FRAMES for x in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            if total[i]:
                held[nodes[i][0]] += 1
                if (nodes[i][1] in _PARTS or frame[i]) and nodes[nodes[i][0]][1] not in _ASIDE:
                    frame[nodes[i][0]] = True
        self.places = [-1] * len(nodes)
        self.parents: list[int] = []
        self.features: list[tuple[int, ...]] = []
        self.kinds: list[int] = []
        above: list[tuple[int, frozenset, int, int]] = [(-1, frozenset(), 2, 0)] * len(nodes)  # place, carried features, kind, frame
        for i, (parent, tag, attrs, words, linked) in enumerate(nodes):
            if i and not total[i]:
                continue
            place, carried, least, below = above[parent] if i else (-1, frozenset(), 2, 0)
            slots, kept, kind = _look(tag, attrs)
            kind = min(kind, least)
            if i and not words and held[i] == 1:
                above[i] = place, carried.union(kept), kind, below
                continue
            self.places[i] = len(self.parents)
            self.parents.append(place)
            self.features.append((*(carried.union(slots) if carried else slots), *(HASHED + j for j in _shape(words, linked, total[i]))))
            self.kinds.append(kind + below)
            above[i] = self.places[i], frozenset(), 2, 3 * frame[i]


def _shape(words: int, linked: int, below: int) -> list[int]:
    """Features of the amount of own text, its link share and the words below."""
    size = min(7, int(math.log2(words + 1)))
    share = 0 if not words else 1 + min(3, int(4 * linked / words - 1e-9)) if linked else 0
    return [size, 8 + share, 13 + (share * 4 + min(3, size // 2)), 33 + min(6, int(math.log2(below + 1)) // 2)]


def _below(nodes) -> list[int]:
    total = [x[3] for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        total[nodes[i][0]] += total[i]
    return total


class TreeModel:
    """weights: HASHED for names, then SHAPES; edges[kind][parent label][child label]: log potentials."""

    def __init__(self, weights, edges, bias):
        self.weights, self.edges, self.bias = list(map(float, weights)), [[list(map(float, r)) for r in e] for e in edges], float(bias)

    def marginals(self, parents: list[int], odds: list[float], kinds: list[int]) -> tuple[list[float], list[float]]:
        """Upward and downward messages as log odds; P(content) of each node, and P(parent and child) of each edge."""
        n = len(parents)
        factors = [[[math.exp(x) for x in r] for r in e] for e in self.edges]
        up, sent = list(odds), [0.0] * n
        for i in range(n - 1, 0, -1):
            e, s = factors[kinds[i]], math.exp(min(30.0, max(-30.0, up[i])))
            sent[i] = math.log((e[1][0] + e[1][1] * s) / (e[0][0] + e[0][1] * s))
            up[parents[i]] += sent[i]
        full, both = list(up), [0.0] * n
        for i in range(1, n):
            e = factors[kinds[i]]
            rest = math.exp(min(30.0, max(-30.0, full[parents[i]] - sent[i])))
            own = math.exp(min(30.0, max(-30.0, up[i])))
            full[i] = up[i] + math.log((e[0][1] + e[1][1] * rest) / (e[0][0] + e[1][0] * rest))
            total = e[0][0] + e[0][1] * own + rest * (e[1][0] + e[1][1] * own)
            both[i] = rest * e[1][1] * own / total
        return [1 / (1 + math.exp(-min(30.0, max(-30.0, x)))) for x in full], both

    def odds(self, tree: Tree) -> list[float]:
        w, bias = self.weights, self.bias
        return [bias + sum([w[j] for j in f]) for f in tree.features]

    def extract(self, page: str | None) -> str:
        """The main text; empty for a null or empty page and for one without content."""
        if not page:
            return ""
        nodes, runs = parse(page)
        tree = Tree(nodes)
        content, _ = self.marginals(tree.parents, self.odds(tree), tree.kinds)
        # each part is decoded by itself: what a tag or a comment parts is no character reference
        blocks = (_SPACE.sub(" ", "".join(map(html.unescape, parts))).strip() for node, parts in runs if tree.places[node] >= 0 and content[tree.places[node]] > 0.5)
        return " ".join(b for b in blocks if b)


_MARK = re.compile(r'\s*data-y="1"')


def train(pages: list[str], rounds: int = 80, penalty: float = 2e-3) -> TreeModel:
    """Maximum likelihood on pages whose content elements carry data-y="1"."""
    trees = []
    for page in pages:
        nodes, _ = parse(page)
        labels = [1 if 'data-y="1"' in x[2] else 0 for x in nodes]
        for x in nodes:
            x[2] = _MARK.sub("", x[2])
        tree = Tree(nodes)
        kept = [label for label, place in zip(labels, tree.places, strict=True) if place >= 0]
        trees.append((tree.parents, kept, tree.features, tree.kinds))
    flat = np.concatenate([np.array(f) for t in trees for f in t[2]])
    owner = np.repeat(np.arange(sum(len(t[0]) for t in trees)), [len(f) for t in trees for f in t[2]])
    labels = np.concatenate([np.array(t[1], dtype=float) for t in trees])
    w, b, edges = np.zeros(HASHED + SHAPES), 0.0, np.zeros((KINDS, 2, 2))
    m, v = np.zeros(len(w) + 1 + KINDS * 4), np.zeros(len(w) + 1 + KINDS * 4)
    for step in range(1, rounds + 1):
        odds = np.bincount(owner, weights=w[flat], minlength=len(labels)) + b
        model = TreeModel([], edges, b)
        expected, g_edges, at = [], np.zeros((KINDS, 2, 2)), 0
        for parents, own, _, kinds in trees:
            p, both = model.marginals(parents, odds[at : at + len(parents)].tolist(), kinds)
            for i in range(1, len(parents)):
                k, up = kinds[i], parents[i]
                g_edges[k, own[up], own[i]] += 1
                g_edges[k, 1, 1] -= both[i]
                g_edges[k, 1, 0] -= p[up] - both[i]
                g_edges[k, 0, 1] -= p[i] - both[i]
                g_edges[k, 0, 0] -= 1 - p[up] - p[i] + both[i]
            expected += p
            at += len(parents)
        gap = labels - np.array(expected)
        g = np.concatenate((np.bincount(flat, weights=gap[owner], minlength=len(w)) / len(trees) - penalty * w, [gap.sum() / len(trees)], (g_edges / len(trees) - penalty * edges).ravel()))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w, b, edges = w + move[: len(w)], b + move[len(w)], edges + move[len(w) + 1 :].reshape(KINDS, 2, 2)
    return TreeModel(w, edges, b)


@lru_cache(maxsize=1)
def default_model() -> TreeModel:
    from sparkloom.llm.labelled_pages import labelled_pages

    return train(labelled_pages())


def extract(pages: DataFrame, html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """pages without html_col, with text (the main text, never null) and n_chars (its code points).
    Null and empty pages have an empty text; very long and very deep ones are read whole. Columns of these two
    names are replaced, all others stay; rows stay one to one, repeated ones too, and an empty table stays
    empty. A node whose marginal is a half exactly is no content."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf("string")
    def main_text(column: pd.Series) -> pd.Series:
        return pd.Series([shared.value.extract(x) for x in column], dtype=object)

    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    return pages.select(*kept, main_text(html_col).alias("text")).select(*kept, "text", F.char_length("text").cast("long").alias("n_chars"))
