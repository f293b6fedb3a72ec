"""Linear models fitted on bounded samples: hinge loss by dual coordinate descent, and Platt scaling."""

from __future__ import annotations

import numpy as np


def fit_hinge(rows: list, values: list | None, labels: np.ndarray, width: int, cost: np.ndarray | float = 1.0, epochs: int = 20, seed: int = 0):
    """(weights, bias) of an L2-regularised hinge-loss model over sparse rows.

    rows: an index array per example; values: a value array per example, or None for ones.
    Dual coordinate descent: one dual variable at a time gets its exact optimum within [0, cost].
    The bias is the weight of a constant feature of value 1.
    """
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    cost = np.broadcast_to(np.asarray(cost, float), y.shape)
    w, b, alpha = np.zeros(width), 0.0, np.zeros(len(y))
    norms = np.array([(len(r) if values is None else float(np.dot(v, v))) + 1.0 for r, v in zip(rows, values or rows)])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            r = rows[i]
            score = (w[r].sum() if values is None else float(np.dot(w[r], values[i]))) + b
            gradient = y[i] * score - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[r] += step if values is None else step * values[i]
                b += step
                moved = max(moved, abs(step) * norms[i] ** 0.5)
        if moved < 1e-3:
            break
    return w, b


def platt(scores: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple:
    """(a, b) of the probability 1 / (1 + exp(-(a * score + b))), by damped Newton steps on smoothed targets."""
    s, y = np.asarray(scores, float), np.asarray(labels, float)
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([s, np.ones_like(s)])
    t = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(t @ x, -30, 30)))
        g = x @ (p - target)
        h = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        t = t - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(t[0]), float(t[1])


def folds_of(n: int, k: int = 3, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).permutation(n) % k


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple:
    """(knots, heights) of an increasing probability by pooling adjacent violators; read by linear interpolation.

    Each pool is smoothed by half an example of either class and spans its scores; heights rise a
    little along a pool, so that order within it is kept.
    """
    order = np.argsort(scores, kind="stable")
    pools: list = []  # positives, examples, least and greatest score
    for s, y in zip(np.asarray(scores, float)[order], np.asarray(labels, float)[order]):
        pools.append([y, 1, s, s])
        while len(pools) > 1 and (pools[-2][0] + 0.5) / (pools[-2][1] + 1) >= (pools[-1][0] + 0.5) / (pools[-1][1] + 1):
            y2, n2, _, s2 = pools.pop()
            pools[-1] = [pools[-1][0] + y2, pools[-1][1] + n2, pools[-1][2], s2]
    heights = [(y + 0.5) / (n + 1) for y, n, _, _ in pools]
    tops = [*heights[1:], 1.0]
    knots = [x for _, _, s, e in pools for x in (s, e)]
    values = [x for h, top in zip(heights, tops) for x in (h, h + 0.05 * (top - h))]
    reach = max(1.0, knots[-1] - knots[0])
    return [knots[0] - reach, *knots, knots[-1] + reach], [heights[0] * 0.9, *values, values[-1] + 0.5 * (1 - values[-1])]
