"""Gradient-boosted trees on small integer features, fitted in numpy and written out as SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: A tree is a float (leaf) or (feature, threshold, tree if feature <= threshold, tree otherwise).
Tree = float | tuple


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, leaf: int, ridge: float) -> Tree:
    value = float(g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2 * leaf:
        return value
    best = (g.sum() ** 2 / (h.sum() + ridge) + 1e-9, None)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            n = low.sum()
            if n < leaf or len(g) - n < leaf:
                continue
            gain = g[low].sum() ** 2 / (h[low].sum() + ridge) + g[~low].sum() ** 2 / (h[~low].sum() + ridge)
            if gain > best[0]:
                best = (gain, (f, cut, low))
    if best[1] is None:
        return value
    f, cut, low = best[1]
    return (f, int(cut), _grow(x[low], g[low], h[low], depth - 1, leaf, ridge), _grow(x[~low], g[~low], h[~low], depth - 1, leaf, ridge))


def evaluate(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, evaluate(low, x), evaluate(high, x))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.3, leaf: int = 5, ridge: float = 1.0) -> list[Tree]:
    """Trees whose sum is the log odds of label 1."""
    trees: list[Tree] = []
    z = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = _scale(_grow(x, y - p, p * (1 - p), depth, leaf, ridge), rate)
        trees.append(tree)
        z += evaluate(tree, x)
    return trees


def _scale(tree: Tree, rate: float) -> Tree:
    return (tree[0], tree[1], _scale(tree[2], rate), _scale(tree[3], rate)) if isinstance(tree, tuple) else tree * rate


def probability(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-sum((evaluate(t, x) for t in trees), np.zeros(len(x)))))


def sql(trees: list[Tree], feature: Callable[[int], str]) -> str:
    """The probability as a SQL expression; ``feature`` gives the expression of a feature's number."""

    def of(tree: Tree) -> str:
        if not isinstance(tree, tuple):
            return f"{float(tree)!r}D"
        f, cut, low, high = tree
        return f"CASE WHEN {feature(f)} <= {cut} THEN {of(low)} ELSE {of(high)} END"

    return f"1.0D / (1.0D + exp(-({' + '.join(map(of, trees)) or '0.0D'})))"
