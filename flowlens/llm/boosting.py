"""Gradient-boosted trees for a binary label: logistic loss, binned features, full trees of one depth."""

from __future__ import annotations

import numpy as np

BINS, DEPTH, TREES, RATE, RIDGE = 32, 4, 60, 0.2, 1.0


class Boosted:
    """`edges[f]` are the bin borders of feature f; a tree is (feature, bin) per inner node and a value per leaf."""

    def __init__(self, edges: list[np.ndarray], base: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.edges, self.base, self.trees = edges, base, trees

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, border, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, feature[node]] > border[node])
            out += leaf[node - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Each tree splits every node where the gain in the second-order loss is largest; ties take the first feature."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(edges, float(np.log(share / (1 - share))), [])
    b, n_features = model.binned(x), x.shape[1]
    score, inner = np.full(len(y), model.base), (1 << DEPTH) - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        feature, border, node = np.zeros(inner, np.int64), np.full(inner, BINS), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, count = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * n_features + np.arange(n_features)) * (BINS + 1) + b
            shape, size = (count, n_features, BINS + 1), count * n_features * (BINS + 1)
            g = np.bincount(cell.ravel(), np.repeat(grad, n_features), size).reshape(shape).cumsum(2)
            h = np.bincount(cell.ravel(), np.repeat(hess, n_features), size).reshape(shape).cumsum(2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(h < 1e-3) | (all_h - h < 1e-3)] = 0
            best = gain.reshape(count, -1).argmax(1)
            useful = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            feature[first : first + count] = best // (BINS + 1)
            border[first : first + count] = np.where(useful, best % (BINS + 1), BINS)
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > border[node])
        leaf_of = node - inner
        g, h = np.bincount(leaf_of, grad, inner + 1), np.bincount(leaf_of, hess, inner + 1)
        leaf = -RATE * g / (h + RIDGE)
        score += leaf[leaf_of]
        model.trees.append((feature, border, leaf))
    return model
