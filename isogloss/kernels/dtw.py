"""Length-normalised dynamic time warping with symmetric steps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Numbers that the differences of some pairs' frames take at once.
BLOCK = 1 << 20


def _equal_shapes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of pairs (x[p], y[p]) of sequences; x: pairs, n, width; y: pairs, m, width.

    A row of g follows from the one above at once: with D the running sum of d along the row and A the better of the
    two steps from above, g = D + running minimum of (A - D).
    """
    g = np.zeros((len(x), y.shape[1]))
    step = max(1, BLOCK // max(1, y.shape[2] * len(x)))
    d = np.empty_like(g)
    for i in range(x.shape[1]):
        for at in range(0, y.shape[1], step):
            away = y[:, at : at + step] - x[:, i : i + 1]
            d[:, at : at + step] = np.sqrt(np.einsum("pmw,pmw->pm", away, away))
        along = np.cumsum(d, 1)
        if not i:
            g = along
            continue
        above = g + d
        above[:, 1:] = np.minimum(above[:, 1:], g[:, :-1] + 2 * d[:, 1:])
        g = along + np.minimum.accumulate(above - along, axis=1)
    return g[:, -1] / (x.shape[1] + y.shape[1])


def normalized_distances(pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each pair g(N-1, M-1) / (N + M), where g(0, 0) = d(0, 0) and
    g(i, j) = min(g(i-1, j-1) + 2 d(i, j), g(i-1, j) + d(i, j), g(i, j-1) + d(i, j)), d Euclidean; NaN without frames.

    Pairs of equal shapes are computed together. Beside the sequences, about BLOCK numbers are held, or a row of g.
    """
    out = np.full(len(pairs), np.nan)
    shapes: dict[tuple, list[int]] = {}
    for k, (x, y) in enumerate(pairs):
        if len(x) and len(y):
            shapes.setdefault((x.shape, y.shape), []).append(k)
    for (n, m), members in shapes.items():
        most = max(1, BLOCK // max(1, (n[0] + m[0]) * n[1]))
        for at in range(0, len(members), most):
            some = members[at : at + most]
            out[some] = _equal_shapes(np.stack([pairs[k][0] for k in some]), np.stack([pairs[k][1] for k in some]))
    return out


def normalized_distance(x: np.ndarray, y: np.ndarray) -> float:
    """normalized_distances of one pair."""
    return float(normalized_distances([(x, y)])[0])
