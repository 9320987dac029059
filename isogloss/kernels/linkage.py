"""Agglomerative clustering of a distance matrix by seven linkages, cophenetic distances and cuts."""

from __future__ import annotations

import numpy as np

METHODS = ("sl", "cl", "ga", "wa", "uc", "wc", "wm")


def _update(method: str, dk_i: np.ndarray, dk_j: np.ndarray, d_ij: float, ni: int, nj: int, nk: np.ndarray) -> np.ndarray:
    """Distances of the other clusters to the union of i and j."""
    n = ni + nj
    if method == "sl":
        return np.minimum(dk_i, dk_j)
    if method == "cl":
        return np.maximum(dk_i, dk_j)
    if method == "ga":
        return (ni * dk_i + nj * dk_j) / n
    if method == "wa":
        return (dk_i + dk_j) / 2
    if method == "uc":
        return (ni * dk_i + nj * dk_j) / n - ni * nj * d_ij / (n * n)
    if method == "wc":
        return (dk_i + dk_j) / 2 - d_ij / 4
    if method == "wm":
        return ((nk + ni) * dk_i + (nk + nj) * dk_j - nk * d_ij) / (nk + n)
    raise ValueError(f"unknown linkage {method!r}")


#: Linkages under which a merged cluster is no nearer to a third one than the nearer of its parts was.
REDUCIBLE = ("sl", "cl", "ga", "wa", "wm")


def _by_chains(w: np.ndarray, method: str) -> list[tuple[int, int, float, int]] | None:
    """Merges by nearest-neighbour chains, sorted afterwards; None where equal distances leave their order open. Each
    cluster is followed to its nearest one until two are each other's nearest, which merge wherever they are in the order,
    so that n merges look at about 3 n rows. w is used up."""
    n = len(w)
    size, live, chain, found = np.ones(n, int), np.ones(n, bool), [], []
    while len(found) < n - 1:
        if not chain:
            chain.append(int(live.argmax()))
        top = chain[-1]
        near = int(w[top].argmin())
        height = w[top, near]
        if np.count_nonzero(w[top] == height) > 1:
            return None
        if len(chain) < 2 or near != chain[-2]:
            chain.append(near)
            continue
        del chain[-2:]
        a, b = min(top, near), max(top, near)
        others = live.copy()
        others[[a, b]] = False
        new = _update(method, w[a, others], w[b, others], float(height), size[a], size[b], size[others])
        w[a, others] = w[others, a] = new
        w[b, :] = w[:, b] = np.inf
        live[b] = False
        size[a] += size[b]
        found.append((float(height), a, b, int(size[a])))
    found.sort()
    if any(x[0] == y[0] for x, y in zip(found, found[1:], strict=False)):
        return None
    # A cluster keeps the slot of its smallest member, so a, b and size are as they were found.
    return [(a, b, height, members) for height, a, b, members in found]


def _by_rows(w: np.ndarray, method: str) -> list[tuple[int, int, float, int]]:
    """Merges in order, of equal distances the pair with the smallest (a, b): each row knows its nearest later one, and
    looks again only where that one has merged. w is used up."""
    n = len(w)
    size, live, out = np.ones(n, int), np.ones(n, bool), []
    near, least = np.zeros(n, int), np.full(n, np.inf)

    def look(i: int) -> None:
        if i + 1 < n:
            near[i] = i + 1 + int(w[i, i + 1 :].argmin())
            least[i] = w[i, near[i]]

    for i in range(n):
        look(i)
    for _ in range(n - 1):
        a = int(least.argmin())
        b, height = int(near[a]), float(least[a])
        others = live.copy()
        others[[a, b]] = False
        new = _update(method, w[a, others], w[b, others], height, size[a], size[b], size[others])
        w[a, others] = w[others, a] = new
        w[b, :] = w[:, b] = np.inf
        live[b], least[b] = False, np.inf
        size[a] += size[b]
        out.append((a, b, height, int(size[a])))
        look(a)
        before = np.flatnonzero(live[:b])
        stale = (near[before] == a) | (near[before] == b)
        for i in before[stale & (before != a)].tolist():
            look(i)
        nearer = before[~stale & (before < a)]
        nearer = nearer[(w[nearer, a] < least[nearer]) | ((w[nearer, a] == least[nearer]) & (a < near[nearer]))]
        near[nearer], least[nearer] = a, w[nearer, a]
    return out


def merges(d: np.ndarray, method: str, squared: bool = False) -> list[tuple[int, int, float, int]]:
    """(a, b, height, size) of the n - 1 merges in order. Clusters are named by their smallest member, a < b; of
    equal distances, the pair with the smallest (a, b) merges. squared: uc, wc and wm work on squared distances and
    give the roots as heights. Only the lower triangle of d counts.

    Reducible linkages are made by chains, in the square of n, unless distances are equal; the others by rows."""
    if method not in METHODS:
        raise ValueError(f"unknown linkage {method!r}")
    w = np.tril(d, -1).astype(float)
    w = w + w.T
    root = squared and method in ("uc", "wc", "wm")
    if root:
        w = w * w
    np.fill_diagonal(w, np.inf)
    out = _by_chains(w.copy(), method) if method in REDUCIBLE else None
    out = _by_rows(w, method) if out is None else out
    return [(a, b, float(np.sqrt(max(0.0, height))), n) for a, b, height, n in out] if root else out


def cophenetic(n: int, tree: list[tuple[int, int, float, int]], max_groups: int | None = None) -> np.ndarray:
    """Height of the merge that first joins each pair; 0 on the diagonal. max_groups: pairs inside one of that many
    top groups get 0."""
    members = {i: [i] for i in range(n)}
    out = np.zeros((n, n))
    zero = n - max_groups if max_groups else 0
    for step, (a, b, height, _) in enumerate(tree):
        rows, columns = members[a], members.pop(b)
        if step >= zero:
            out[np.ix_(rows, columns)] = height
            out[np.ix_(columns, rows)] = height
        members[a] = rows + columns
    return out


def cut(n: int, tree: list[tuple[int, int, float, int]], k: int) -> np.ndarray:
    """Labels 0, 1, ... of the k groups that are left without the last k - 1 merges, by their smallest member. The
    order of merges decides, not heights, which centroid linkages may invert."""
    label = np.arange(n)
    for a, b, _, _ in tree[: max(0, n - k)]:
        label[label == b] = a
    return np.unique(label, return_inverse=True)[1]
