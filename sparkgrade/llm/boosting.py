"""Gradient-boosted trees for a few classes, in numpy: histograms of binned features, trees grown level by level."""

from __future__ import annotations

import numpy as np

BINS = 32
_RIDGE, _LEAST_HESSIAN = 1.0, 2.0


class _Tree:
    """A complete tree: the feature and bin that split each inner node (feature -1: all go left), and the leaves' values."""

    def __init__(self, depth: int) -> None:
        self.features, self.bins = np.full((1 << depth) - 1, -1, np.int64), np.zeros((1 << depth) - 1, np.uint8)
        self.leaves, self.depth = np.zeros(1 << depth), depth

    def places(self, binned: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for level in range(self.depth):
            node = at + (1 << level) - 1
            feature = self.features[node]
            at = 2 * at + ((feature >= 0) & (binned[rows, np.maximum(feature, 0)] > self.bins[node]))
        return at


def _grown(binned: np.ndarray, sizes: list[int], gradient: np.ndarray, hessian: np.ndarray, depth: int, rate: float) -> tuple[_Tree, np.ndarray]:
    """A tree that fits gradient over hessian, and the leaf of each row. sizes: the bins of each feature."""
    tree, at, rows = _Tree(depth), np.zeros(len(binned), np.int64), np.arange(len(binned))
    worth = lambda g, h: g * g / (h + _RIDGE)
    for level in range(depth):
        nodes = 1 << level
        best, feature, bins = np.full(nodes, 1e-6), np.full(nodes, -1, np.int64), np.zeros(nodes, np.uint8)
        for f, size in enumerate(sizes):
            if size < 2:
                continue
            key = at * size + binned[:, f]
            g, h = (np.bincount(key, weights=x, minlength=nodes * size).reshape(nodes, size).cumsum(1) for x in (gradient, hessian))
            left, right = h[:, :-1], h[:, -1:] - h[:, :-1]
            gain = worth(g[:, :-1], left) + worth(g[:, -1:] - g[:, :-1], right) - worth(g[:, -1:], h[:, -1:])
            gain[(left < _LEAST_HESSIAN) | (right < _LEAST_HESSIAN)] = 0
            top = gain.argmax(1)
            value = gain[np.arange(nodes), top]
            better = value > best
            best[better], feature[better], bins[better] = value[better], f, top[better]
        tree.features[nodes - 1 : 2 * nodes - 1], tree.bins[nodes - 1 : 2 * nodes - 1] = feature, bins
        at = 2 * at + ((feature[at] >= 0) & (binned[rows, np.maximum(feature[at], 0)] > bins[at]))
    g, h = (np.bincount(at, weights=x, minlength=1 << depth) for x in (gradient, hessian))
    tree.leaves = rate * g / (h + _RIDGE)
    return tree, at


class BoostedTrees:
    """Class probabilities by a softmax over sums of trees, one tree a class and round. Deterministic."""

    def __init__(self, x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 25, depth: int = 4, rate: float = 0.3) -> None:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
        counts = np.bincount(y, minlength=classes) + 1.0
        self.start, self.rounds = np.log(counts / counts.sum()), []
        sizes = [len(e) + 1 for e in self.edges]
        binned, scores, wanted = np.asfortranarray(self.binned(x)), np.tile(self.start, (len(x), 1)), np.eye(classes)[y]
        for _ in range(rounds if len(x) else 0):
            p, trees = _softmax(scores), []
            for c in range(classes):
                tree, leaves = _grown(binned, sizes, wanted[:, c] - p[:, c], np.maximum(p[:, c] * (1 - p[:, c]), 1e-6), depth, rate)
                scores[:, c] += tree.leaves[leaves]
                trees.append(tree)
            self.rounds.append(trees)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], axis=1).astype(np.uint8) if self.edges else np.zeros((len(x), 0), np.uint8)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        binned, scores = self.binned(x), np.tile(self.start, (len(x), 1))
        for trees in self.rounds:
            for c, tree in enumerate(trees):
                scores[:, c] += tree.leaves[tree.places(binned)]
        return np.log(np.maximum(_softmax(scores), 1e-12))


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)
