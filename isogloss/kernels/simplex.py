"""The transportation problem by the simplex method on a tree, with potentials that prove the flow cheapest."""

from __future__ import annotations

import numpy as np


def _start(p: np.ndarray, q: np.ndarray, cost: np.ndarray) -> dict[tuple[int, int], float]:
    """A first basis: the cell that is cheapest against the dearest cells left in its row and its column is filled
    as far as both allow, and closes one of them; m + n - 1 cells, some perhaps empty."""
    m, n = cost.shape
    supply, demand, basis = p.copy(), q.copy(), {}
    rows, columns = np.arange(m), np.arange(n)
    while len(rows) and len(columns):
        part = cost[np.ix_(rows, columns)]
        gain = part - part.max(1)[:, None] - part.max(0)[None]
        at = int(gain.argmin())
        i, j = int(rows[at // len(columns)]), int(columns[at % len(columns)])
        amount = min(supply[i], demand[j])
        basis[i, j] = amount
        supply[i] -= amount
        demand[j] -= amount
        # One side is closed for each cell, the last cell closes both.
        if (supply[i] <= demand[j] and len(rows) > 1) or len(columns) == 1:
            rows = rows[rows != i]
        else:
            columns = columns[columns != j]
    return basis


def _hang(beside: list[set[int]], m: int, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent, depth and potential of each node (rows, then columns) of the basis tree hung from row 0."""
    parent, depth, value = np.full(len(beside), -1), np.zeros(len(beside), int), np.zeros(len(beside))
    todo = [0]
    for node in todo:
        for other in beside[node]:
            if other != parent[node]:
                parent[other], depth[other] = node, depth[node] + 1
                value[other] = (cost[node, other - m] if node < m else cost[other, node - m]) - value[node]
                todo.append(other)
    return parent, depth, value


def _cycle(i: int, j: int, parent: np.ndarray, depth: np.ndarray) -> list[int]:
    """The tree's path from node i to node j."""
    left, right = [i], [j]
    while left[-1] != right[-1]:
        if depth[left[-1]] >= depth[right[-1]]:
            left.append(int(parent[left[-1]]))
        else:
            right.append(int(parent[right[-1]]))
    return left + right[-2::-1]


def solve(p: np.ndarray, q: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cheapest flow from masses p to masses q, not negative and of equal sums, and potentials u of p and v of q:
    u + v is at most the cost everywhere and is the cost where something flows, so that p u + q v is the flow's cost.

    The cell with the least reduced cost enters; of cells that limit the change the first leaves. Where a run of
    changes moves nothing, the first cell with a negative reduced cost enters instead, so that no basis comes back.
    """
    m, n = cost.shape
    basis = _start(p, q, cost)
    beside: list[set[int]] = [set() for _ in range(m + n)]
    for i, j in basis:
        beside[i].add(m + j)
        beside[m + j].add(i)
    slack, still = 1e-12 * max(1e-300, float(np.abs(cost).max(initial=0.0))), 0
    while True:
        parent, depth, value = _hang(beside, m, cost)
        u, v = value[:m], value[m:]
        reduced = cost - u[:, None] - v[None]
        at = int(reduced.argmin()) if still <= m + n else int((reduced < -slack).argmax())
        i, j = divmod(at, n)
        if reduced[i, j] >= -slack:
            break
        path = _cycle(i, m + j, parent, depth)
        # From row i along the tree to column j: every other cell gives up what the new one carries.
        cells = [(a, b - m) if a < m else (b, a - m) for a, b in zip(path, path[1:], strict=False)]
        giving = cells[::2]
        amount = min(basis[c] for c in giving)
        leaving = min(c for c in giving if basis[c] == amount)
        for k, c in enumerate(cells):
            basis[c] += amount if k % 2 else -amount
        basis.pop(leaving)
        basis[i, j] = amount
        beside[leaving[0]].discard(m + leaving[1])
        beside[m + leaving[1]].discard(leaving[0])
        beside[i].add(m + j)
        beside[m + j].add(i)
        still = 0 if amount > 0 else still + 1
    flow = np.zeros((m, n))
    for (i, j), amount in basis.items():
        flow[i, j] = max(0.0, amount)
    return flow, u, v
