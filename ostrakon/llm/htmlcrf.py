"""HTML extraction by a tree-structured graphical model.

Each element of a page's tree is a binary variable: part of the main text or
not.  Elements have potentials from their tag, the words of their class and
id, the share of linked text, length and punctuation; a parent and child have
a table of potentials that depends on the kind of the child.  Sum-product
messages pass up from the leaves and down from the root and give the exact
marginal of each element.  Weights maximise the likelihood of labelled pages
(``htmlpages``); their gradient is the difference between labels and
marginals.

Text is taken from elements whose marginal is at least one half: runs of
inline content form blocks, white space within a block becomes one space, and
blocks are joined by two line feeds in page order.  Nothing else is left out.

Defined cases: null and empty pages give the empty text; pages of any length
and depth are read whole; broken markup is mended; repeated rows give repeated
results; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts_of
from .htmlpages import labelled_pages
from .htmltree import INLINE, Node, parse

SKIPPED = frozenset("head script style title textarea select option datalist".split())
#: The kinds of a child that have pair potentials of their own; elements in none are 3, inline ones 4.
KINDS = {t: k for k, tags in enumerate(("article main", "body div section details figure html", "aside dialog footer form header nav fieldset")) for t in tags.split()}
N_KINDS = 5
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Flat:
    """Pages as arrays: parent (-1 for roots), depth, kind of the edge to the parent, features (row, name), elements."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)


@lru_cache(50_000)
def own_features(tag: str, name: str) -> tuple[str, ...]:
    """Features of the tag and of the words in class, id and role."""
    words = {w.lower() for w in _WORDS.findall(name)}
    stems = {w[:5] for w in words if len(w) > 4}
    return (f"t={tag}", "bias", *(f"c={w}" for w in sorted(words)), *(f"s={w}" for w in sorted(stems)), *(("named",) if words else ()), *((f"n={tag}",) if not words else ()))


def _add(flat: Flat, root: Node) -> None:
    """Append a page's elements in document order, parents first."""
    stack = [(root, -1, 0)]
    first = len(flat.nodes)
    while stack:
        node, parent, depth = stack.pop()
        at = len(flat.nodes)
        flat.nodes.append(node)
        flat.parent.append(parent)
        flat.depth.append(depth)
        flat.kind.append(KINDS.get(node.tag, 4 if node.tag in INLINE else 3))
        stack.extend((c, at, depth + 1) for c in reversed(node.children) if not isinstance(c, str) and c.tag not in SKIPPED)
    n = len(flat.nodes) - first
    chars, linked, marks, blocks, titles = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        node = flat.nodes[first + i]
        for c in node.children:
            if isinstance(c, str):
                size = len(c) if not c.isspace() else 0
                chars[i] += size
                if size:
                    marks[i] += c.count(". ") + c.count(", ") + c.rstrip().endswith((".", "!", "?"))
        if node.tag == "a":
            linked[i] = chars[i]
        if node.tag == "p":
            blocks[i] += 1
        if node.tag == "h1":
            titles[i] = 1
        p = flat.parent[first + i] - first
        if i:
            chars[p] += chars[i]
            linked[p] += linked[i]
            marks[p] += marks[i]
            blocks[p] += blocks[i]
            titles[p] += titles[i]
    for i in range(n):
        node = flat.nodes[first + i]
        a = node.attrs
        names = own_features(node.tag, f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}" if a else "")
        share = linked[i] / chars[i] if chars[i] else 0.0
        linked_bin = 0 if not share else 1 + int(share * 3.99)
        if flat.kind[first + i] < 3:
            told = (f"l={min(12, chars[i].bit_length())}", f"a={linked_bin}", f"m={min(4, marks[i].bit_length())}", f"p={min(3, blocks[i])}", f"h={min(1, titles[i])}{node.tag}", f"f={int(3.99 * chars[i] / max(1, chars[0]))}")
        else:
            told = (f"L={min(5, chars[i].bit_length())}", f"A={linked_bin}", f"M={min(1, marks[i])}")
        flat.names.extend(names)
        flat.names.extend(told)
        flat.rows.extend([first + i] * (len(names) + len(told)))


def flatten(roots: list[Node]) -> Flat:
    flat = Flat()
    for root in roots:
        _add(flat, root)
    return flat


class Messages:
    """The order of messages over a forest: elements by depth."""

    def __init__(self, parent: np.ndarray, depth: np.ndarray, kind: np.ndarray):
        self.parent, self.kind = parent, kind
        order = np.argsort(depth, kind="stable")
        ends = np.cumsum(np.bincount(depth)) if len(depth) else np.empty(0, int)
        self.levels = [order[e - n : e] for e, n in zip(ends, np.diff(ends, prepend=0))]

    def run(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-odds of the marginals, log-odds below each element, log-odds of its parent without it).

        ``pair[kind, parent's value, child's value]`` are log potentials.
        """
        below = unary.copy()
        up = np.zeros(len(unary))
        t = pair[self.kind]
        for level in self.levels[:0:-1]:
            b, q = below[level], t[level]
            up[level] = np.logaddexp(q[:, 1, 0], b + q[:, 1, 1]) - np.logaddexp(q[:, 0, 0], b + q[:, 0, 1])
            np.add.at(below, self.parent[level], up[level])
        total, without = below.copy(), np.zeros(len(unary))
        for level in self.levels[1:]:
            w = total[self.parent[level]] - up[level]
            q = t[level]
            total[level] = below[level] + np.logaddexp(q[:, 0, 1], w + q[:, 1, 1]) - np.logaddexp(q[:, 0, 0], w + q[:, 1, 0])
            without[level] = w
        return total, below, without


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    pair: np.ndarray

    def unary(self, flat: Flat) -> np.ndarray:
        get = self.index.get
        w = np.append(self.weights, 0.0)[[get(n, -1) for n in flat.names]]
        return np.bincount(flat.rows, w, minlength=len(flat.nodes))

    def marginals(self, flat: Flat) -> np.ndarray:
        """The probability of each element to be main text."""
        if not flat.nodes:
            return np.empty(0)
        total, _, _ = Messages(np.array(flat.parent), np.array(flat.depth), np.array(flat.kind)).run(self.unary(flat), self.pair)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def labels_of(flat: Flat) -> np.ndarray:
    """Labels that ``data-y`` states; elements without one take their parent's."""
    y = np.zeros(len(flat.nodes))
    for i, (node, p) in enumerate(zip(flat.nodes, flat.parent)):
        stated = node.attrs.get("data-y")
        y[i] = float(stated) if stated is not None else (y[p] if p >= 0 else 0.0)
    return y


def gradient(messages: Messages, x: tuple[np.ndarray, np.ndarray], n_features: int, y: np.ndarray, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood, by weights and by pair potentials."""
    rows, columns = x
    total, below, without = messages.run(np.bincount(rows, weights[columns], minlength=len(y)), pair)
    p = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
    by_weight = np.bincount(columns, (y - p)[rows], minlength=n_features)
    inner = np.flatnonzero(messages.parent >= 0)
    a = np.array([0.0, 1.0])
    logs = without[inner][:, None, None] * a[None, :, None] + pair[messages.kind[inner]] + below[inner][:, None, None] * a[None, None, :]
    logs -= logs.max((1, 2), keepdims=True)
    e = np.exp(logs)
    e /= e.sum((1, 2), keepdims=True)
    true = np.zeros_like(e)
    true[np.arange(len(inner)), y[messages.parent[inner]].astype(int), y[inner].astype(int)] = 1
    by_pair = np.zeros_like(pair)
    np.add.at(by_pair, messages.kind[inner], true - e)
    return by_weight, by_pair


def train(pages: list[str], rounds: int = 500, rate: float = 0.12, l2: float = 0.1, least: int = 2) -> Model:
    """Maximum likelihood on labelled pages with a ridge penalty, by Adam on the whole set."""
    flat = flatten([parse(p) for p in pages])
    y = labels_of(flat)
    seen: dict[str, int] = {}
    for n in flat.names:
        seen[n] = seen.get(n, 0) + 1
    index = {n: i for i, n in enumerate(sorted(n for n, c in seen.items() if c >= least))}
    rows = np.array(flat.rows)
    columns = np.array([index.get(n, len(index)) for n in flat.names])
    k = len(index) + 1
    messages = Messages(np.array(flat.parent), np.array(flat.depth), np.array(flat.kind))
    w, pair = np.zeros(k), np.zeros((N_KINDS, 2, 2))
    state = [np.zeros(k + 4 * N_KINDS), np.zeros(k + 4 * N_KINDS)]
    for t in range(1, rounds + 1):
        gw, gp = gradient(messages, (rows, columns), k, y, w, pair)
        g = np.concatenate([gw - l2 * w, gp.ravel() - l2 * pair.ravel()])
        g[k - 1] = 0
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        step = rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w, pair = w + step[:k], pair + step[k:].reshape(N_KINDS, 2, 2)
    return Model(index, w[:-1], pair)


@lru_cache(4)
def trained(pages: int = 500, seed: int = 0) -> Model:
    """The model of so many labelled pages; made once a process."""
    return train(labelled_pages(pages, seed))


def blocks_of(root: Node, content: dict[int, bool]) -> list[str]:
    """The blocks of main text of a page; ``content`` says of each element, by identity, whether it is."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack: list[tuple[Node | str | None, bool]] = [(root, False)]
    while stack:
        item, inside = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            if inside:
                run.append(item)
        elif item.tag in SKIPPED:
            continue
        elif item.tag in ("br", "wbr"):
            if inside and item.tag == "br":
                run.append(" ")
        else:
            mine = content.get(id(item), inside)
            block = item.tag not in INLINE
            if block:
                end()
                stack.append((None, False))
            stack.extend((c, mine) for c in reversed(item.children))
    end()
    return out


def extract(pages: list[str], model: Model) -> list[str]:
    """The main text of each page."""
    roots = [parse(p) for p in pages]
    flat = flatten(roots)
    told = model.marginals(flat) >= 0.5
    content = {id(n): bool(c) for n, c in zip(flat.nodes, told)}
    return ["\n\n".join(blocks_of(r, content)) for r in roots]


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``; the model's size follows its training pages only."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = extract(texts_of(part, "html"), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
