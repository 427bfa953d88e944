"""Decision trees and forests in numpy, fitted on small labelled tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    """A leaf has no feature; left takes what is at or under the threshold."""

    share: float
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int, least: int = 3, features: int | None = None, rng: np.random.Generator | None = None) -> Node:
    """Gini splits at midpoints; ``features`` of them, drawn anew, are looked at for each split."""
    node = Node(round(float(y.mean()), 6))
    if depth == 0 or len(y) < 2 * least or node.share in (0.0, 1.0):
        return node
    pool = np.arange(x.shape[1]) if features is None or rng is None else np.sort(rng.choice(x.shape[1], features, replace=False))
    best = (1e-9, -1, 0.0)
    whole = node.share * (1 - node.share) * len(y)
    for f in pool:
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[:-1] < v[1:])
        cut = cut[(cut + 1 >= least) & (len(y) - cut - 1 >= least)]
        if len(cut):
            n, ones = cut + 1.0, t[cut].astype(float)
            m, rest = len(y) - n, t[-1] - ones
            gain = whole - ones * (1 - ones / n) - rest * (1 - rest / m)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if best[1] < 0:
        return node
    node.feature, node.threshold = best[1], round(best[2], 6)
    side = x[:, node.feature] <= node.threshold
    if side.all() or not side.any():
        return Node(node.share)
    node.left = fit_tree(x[side], y[side], depth - 1, least, features, rng)
    node.right = fit_tree(x[~side], y[~side], depth - 1, least, features, rng)
    return node


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 12, depth: int = 5, seed: int = 3) -> list[Node]:
    rng = np.random.default_rng(seed)
    some = max(1, round(x.shape[1] ** 0.5) + 1)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(fit_tree(x[rows], y[rows], depth, 2, some, rng))
    return out


def shares(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.share)
    side = x[:, node.feature] <= node.threshold
    out = np.empty(len(x))
    out[side], out[~side] = shares(node.left, x[side]), shares(node.right, x[~side])
    return out


def as_sql(node: Node, names: list[str]) -> str:
    """The tree as a CASE expression over ``names``."""
    if node.feature < 0:
        return f"cast({node.share:.6f} as double)"
    return f"case when {names[node.feature]} <= cast({node.threshold:.6f} as double) then {as_sql(node.left, names)} else {as_sql(node.right, names)} end"
