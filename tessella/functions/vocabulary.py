"""A tree of visual words: k-means splits of a bounded sample, and the word of a descriptor by descent."""

from __future__ import annotations

import numpy as np

# Branching, depth, iterations of a split, descriptors of the sample, seed.
BRANCHING, DEPTH, ITERATIONS, SAMPLE, SEED = 10, 3, 8, 30_000, 0x5EED1234ABCD0001


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest centre, the lowest index on ties."""
    d = np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T, 0)
    i = d.argmin(1)
    return i, d[np.arange(len(x)), i]


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres: starts drawn in proportion to squared distance, then means; an empty cluster takes the row furthest from its centre."""
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        d = nearest(x, centres)[1]
        total = d.sum()
        at = int(np.searchsorted(d.cumsum(), rng.random() * total)) if total > 0 else int(rng.integers(len(x)))
        centres = np.vstack([centres, x[min(at, len(x) - 1)]])
    for _ in range(iterations):
        label, d = nearest(x, centres)
        count = np.bincount(label, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        for c, far in zip(np.flatnonzero(count == 0), np.argsort(-d, kind="stable")):
            centres[c] = x[far]
    return nearest(x, centres)[0], centres


def train(x: np.ndarray, branching: int = BRANCHING, depth: int = DEPTH, iterations: int = ITERATIONS, seed: int = SEED) -> list[dict]:
    """Nodes of the tree, the root first: centres and the children's numbers, or a word for a leaf. A node of fewer than twice branching rows
    or at the depth is a leaf."""
    rng = np.random.default_rng(seed)
    nodes, todo, words = [{}], [(0, np.arange(len(x)), 0)], 0
    while todo:
        at, rows, level = todo.pop()
        if level >= depth or len(rows) < 2 * branching:
            nodes[at]["word"] = words
            words += 1
            continue
        label, centres = kmeans(x[rows], branching, rng, iterations)
        nodes[at] = {"centres": centres, "children": list(range(len(nodes), len(nodes) + branching))}
        for c in range(branching):
            nodes.append({})
            todo.append((nodes[at]["children"][c], rows[label == c], level + 1))
    return nodes


def words(nodes: list[dict], x: np.ndarray) -> np.ndarray:
    """Word of each row: down the nearest centre of each node."""
    out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if "word" in nodes[at]:
            out[rows] = nodes[at]["word"]
        elif len(rows):
            label = nearest(x[rows], nodes[at]["centres"])[0]
            todo += [(child, rows[label == c]) for c, child in enumerate(nodes[at]["children"])]
    return out
