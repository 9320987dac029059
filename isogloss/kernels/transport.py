"""Exact optimal transport between discrete masses, and the two-level distance of clusterings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from . import simplex

METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "euclidean": lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)),
    "sqeuclidean": lambda a, b: ((a[:, None] - b[None]) ** 2).sum(2),
    "cityblock": lambda a, b: np.abs(a[:, None] - b[None]).sum(2),
    "circle": lambda a, b: np.mod(a[:, None, 0] - b[None, :, 0], 1.0),
}


def ground_costs(a: np.ndarray, b: np.ndarray, metric: str | Callable = "euclidean") -> np.ndarray:
    """Costs between points: a metric's name, or a function of two points."""
    if callable(metric):
        return np.array([[float(metric(x, y)) for y in b] for x in a])
    return METRICS[metric](np.asarray(a, float), np.asarray(b, float))


def optimum(p: Sequence[float], q: Sequence[float], cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cheapest flow from masses p to masses q and its potentials (see simplex.solve).

    Masses must be non-negative and have equal sums (within 1e-4 of each other, relative; a smaller rest than that
    is left where it is, at no cost, as its potentials are at most 0 there); else ValueError.
    """
    p, q, cost = np.array(p, float), np.array(q, float), np.asarray(cost, float)
    if (p < 0).any() or (q < 0).any() or not np.isfinite(cost).all():
        raise ValueError("masses must not be negative, costs must be finite")
    rest, total = p.sum() - q.sum(), max(p.sum(), q.sum())
    if abs(rest) > 1e-4 * max(total, 1e-300):
        raise ValueError("masses have different sums")
    m, n = cost.shape
    if abs(rest) <= 1e-12 * total:
        q[-1] = max(0.0, q[-1] + rest)
        return simplex.solve(p, q, cost)
    # The rest goes to, or comes from, a place that costs nothing.
    wide = np.zeros((m + (rest < 0), n + (rest > 0)))
    wide[:m, :n] = cost
    moved, u, v = simplex.solve(np.append(p, -rest) if rest < 0 else p, np.append(q, rest) if rest > 0 else q, wide)
    return moved[:m, :n], u[:m], v[:n]


def flow(p: Sequence[float], q: Sequence[float], cost: np.ndarray) -> np.ndarray:
    """The flow of optimum."""
    return optimum(p, q, cost)[0]


def emd(p: Sequence[float], q: Sequence[float], cost: np.ndarray) -> float:
    """The least cost of moving masses p to q."""
    cost = np.asarray(cost, float)
    if 1 in cost.shape:
        total = np.asarray(q if cost.shape[0] == 1 else p, float)
        return float((cost.ravel() * total).sum())
    return float((flow(p, q, cost) * cost).sum())


def emd_line(x: np.ndarray, y: np.ndarray) -> float:
    """emd of uniform masses on a line with absolute differences as costs: the area between the two distribution
    functions."""
    at = np.concatenate([x, y])
    step = np.concatenate([np.full(len(x), 1 / len(x)), np.full(len(y), -1 / len(y))])
    order = np.argsort(at, kind="stable")
    return float((np.abs(np.cumsum(step[order]))[:-1] * np.diff(at[order])).sum())


def flow_triples(moved: np.ndarray) -> list[tuple[int, int, float]]:
    """(from, to, amount) of the arcs that carry something."""
    return [(int(i), int(j), float(moved[i, j])) for i, j in np.argwhere(moved > 0)]


def clusterify(points: Sequence, labels: Sequence) -> list[np.ndarray]:
    """Points by label, labels in ascending order, points in theirs."""
    points, labels = np.asarray(points, float), list(labels)
    points = points[:, None] if points.ndim == 1 else points
    if len(points) != len(labels):
        raise ValueError("as many labels as points are needed")
    return [points[[k for k, v in enumerate(labels) if v == label]] for label in sorted(set(labels))]


def between_clusters(s1: list[np.ndarray], s2: list[np.ndarray], metric: str | Callable = "euclidean") -> np.ndarray:
    """Transport costs between clusters, each with uniform mass. The metric `line` stands for absolute differences
    of one coordinate, for which no problem needs solving."""
    if metric == "line":
        return np.array([[emd_line(a[:, 0], b[:, 0]) for b in s2] for a in s1])
    return np.array([[emd(np.full(len(a), 1 / len(a)), np.full(len(b), 1 / len(b)), ground_costs(a, b, metric)) for b in s2] for a in s1])


def cdistance(s1: list[np.ndarray], s2: list[np.ndarray], metric: str | Callable = "euclidean") -> float | None:
    """Optimal over naive transport cost of two clusterings, whose clusters' masses are their shares of the points
    and whose ground costs are between_clusters; None where the naive cost is 0."""
    d = between_clusters(s1, s2, metric)
    p, q = (np.array([len(c) for c in s], float) / sum(len(c) for c in s) for s in (s1, s2))
    naive = float(p @ d @ q)
    return emd(p, q, d) / naive if naive else None
