import itertools
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from isogloss.kernels import dtw, linkage, transport
from isogloss.kernels.dtw import normalized_distance

# Published distances of three clusterings of seven points, at four digits.
BASE = [(2, 10), (3, 9), (4, 10), (5, 3), (6, 2), (7, 3), (6, 1)]
LABELS = [1, 1, 1, 2, 2, 2, 2]


def moved(up: float) -> list:
    return [*BASE[:3], *[(x, y + up) for x, y in BASE[3:6]], BASE[6]]


@pytest.mark.parametrize(("a", "b", "expected"), [(0, 0.8, 0.0861), (0.8, 0.85, 0.0059), (0.85, 0, 0.0914)])
def test_published_cdistances(a, b, expected):
    s, t = transport.clusterify(moved(a), LABELS), transport.clusterify(moved(b), LABELS)
    assert round(transport.cdistance(s, t), 4) == expected
    assert transport.cdistance(s, t) == pytest.approx(transport.cdistance(t, s))


def test_cdistance_of_itself_and_undefined():
    s = transport.clusterify(BASE, LABELS)
    assert transport.cdistance(s, s) == pytest.approx(0)
    assert transport.cdistance(s, transport.clusterify(BASE, [7 if v == 1 else 3 for v in LABELS])) == pytest.approx(0)
    one = [np.array([[1.0, 1.0]])]
    assert transport.cdistance(one, one) is None


def brute_dtw(x, y):
    g = np.full((len(x), len(y)), np.inf)
    for i, j in itertools.product(range(len(x)), range(len(y))):
        d = float(np.sqrt(((x[i] - y[j]) ** 2).sum()))
        if i == j == 0:
            g[i, j] = d
        else:
            g[i, j] = min(g[i - 1, j - 1] + 2 * d if i and j else np.inf, g[i - 1, j] + d if i else np.inf, g[i, j - 1] + d if j else np.inf)
    return g[-1, -1] / (len(x) + len(y))


@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 10**6))
@settings(deadline=None, max_examples=60)
def test_dtw(n, m, seed):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, 3)), rng.normal(size=(m, 3))
    assert normalized_distance(x, y) == pytest.approx(brute_dtw(x, y))
    assert normalized_distance(x, y) == pytest.approx(normalized_distance(y, x))
    assert normalized_distance(x, x) == 0


@pytest.mark.parametrize("width", [1, 64, 256, 257, 1024])
def test_dtw_of_any_width(width):
    rng = np.random.default_rng(width)
    x, y = rng.normal(size=(7, width)), rng.normal(size=(5, width))
    assert normalized_distance(x, y) == pytest.approx(brute_dtw(x, y), rel=1e-12)
    assert normalized_distance(x, x) == 0
    # Large numbers with small differences: nothing cancels.
    assert normalized_distance(x + 1e6, y + 1e6) == pytest.approx(brute_dtw(x + 1e6, y + 1e6), rel=1e-12)


def test_dtw_of_many_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    some = [rng.normal(size=(n, 3)) for n in (4, 4, 5, 4, 1, 0)]
    pairs = [(x, y) for x in some for y in some]
    for block in (1, 50, 1 << 20):
        monkeypatch.setattr(dtw, "BLOCK", block)
        for (x, y), d in zip(pairs, dtw.normalized_distances(pairs), strict=True):
            assert np.isnan(d) if not len(x) or not len(y) else d == pytest.approx(brute_dtw(x, y))


def test_dtw_of_long_recordings_is_bounded():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(4000, 64)), rng.normal(size=(4000, 64))
    tracemalloc.start()
    assert 0 < normalized_distance(x, y) < 20
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def brute_transport(p, q, cost):
    """The least cost over all basic solutions: flows on as many arcs as rows and columns less one."""
    m, n = cost.shape
    rows = np.vstack([np.kron(np.eye(m), np.ones(n)), np.kron(np.ones(m), np.eye(n))])[:-1]
    want, best = np.concatenate([p, q])[:-1], np.inf
    for arcs in itertools.combinations(range(m * n), m + n - 1):
        part = rows[:, arcs]
        if abs(np.linalg.det(part)) > 0.5:
            amount = np.linalg.solve(part, want)
            if amount.min() > -1e-12:
                best = min(best, float(amount @ cost.ravel()[list(arcs)]))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_transport_against_all_basic_solutions(seed):
    rng = np.random.default_rng(seed)
    m, n = rng.integers(2, 4, 2)
    p, q = rng.dirichlet(np.ones(m)), rng.dirichlet(np.ones(n))
    if seed % 3 == 0:
        p, q = np.full(m, 1 / m), np.full(n, 1 / n)
    a, b = rng.normal(size=(m, 2)), rng.normal(size=(n, 2))
    cost = np.round(transport.ground_costs(a, b), seed % 4)
    assert transport.emd(p, q, cost) == pytest.approx(brute_transport(p, q, cost))


@pytest.mark.parametrize("seed", range(6))
def test_cdistance_in_the_plane_against_all_basic_solutions(seed):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(8, 2))
    s, t = (transport.clusterify(points, rng.permutation([0, 0, 0, 1, 1, 1, 2, 2])) for _ in range(2))

    def emd(a, b):
        return brute_transport(np.full(len(a), 1 / len(a)), np.full(len(b), 1 / len(b)), np.sqrt(((a[:, None] - b) ** 2).sum(2)))

    d = np.array([[emd(a, b) for b in t] for a in s])
    p, q = (np.array([len(c) / 8 for c in x]) for x in (s, t))
    assert transport.cdistance(s, t) == pytest.approx(brute_transport(p, q, d) / (p @ d @ q))


@given(st.integers(1, 6), st.integers(0, 10**6))
@settings(deadline=None, max_examples=60)
def test_transport_of_equal_masses_is_the_best_assignment(n, seed):
    cost = np.random.default_rng(seed).integers(0, 20, (n, n)).astype(float)
    best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))) / n
    assert transport.emd(np.full(n, 1 / n), np.full(n, 1 / n), cost) == pytest.approx(best)


@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 10**6))
@settings(deadline=None, max_examples=60)
def test_transport_on_a_line(n, m, seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 6, n).astype(float), rng.normal(size=m)
    p, q = np.full(n, 1 / n), np.full(m, 1 / m)
    cost = np.abs(x[:, None] - y)
    assert transport.emd(p, q, cost) == pytest.approx(transport.emd_line(x, y))
    f = transport.flow(p, q, cost)
    assert f.sum(1) == pytest.approx(p) and f.sum(0) == pytest.approx(q)
    assert len(transport.flow_triples(f)) >= max(n, m)


def test_transport_rejects_unequal_masses():
    with pytest.raises(ValueError, match="sums"):
        transport.flow([0.5, 0.5], [0.5, 0.6], np.zeros((2, 2)))
    with pytest.raises(ValueError, match="negative"):
        transport.flow([1.5, -0.5], [0.5, 0.5], np.zeros((2, 2)))


def matrix(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 2))
    return np.sqrt(((x[:, None] - x) ** 2).sum(2))


@pytest.mark.parametrize("method", linkage.METHODS)
def test_linkage_properties(method):
    for seed in range(5):
        d = matrix(12, seed)
        tree = linkage.merges(d, method)
        heights = [h for _, _, h, _ in tree]
        assert len(tree) == 11 and tree[-1][3] == 12
        if method not in ("uc", "wc"):
            assert heights == sorted(heights)
        for k in (1, 2, 4, 12):
            assert len(set(linkage.cut(12, tree, k))) == k
        c = linkage.cophenetic(12, tree)
        assert (c == c.T).all() and (np.diag(c) == 0).all()
        if method == "sl":
            assert (c <= d + 1e-12).all()
        if method == "cl":
            assert (c >= d - 1e-12).all()


def test_average_linkage_is_the_mean_between_clusters():
    d = matrix(9, 3)
    members = {i: [i] for i in range(9)}
    for a, b, h, _ in linkage.merges(d, "ga"):
        assert h == pytest.approx(d[np.ix_(members[a], members[b])].mean())
        members[a] += members.pop(b)


def test_centroid_inversion_cut_by_merges():
    d = np.array([[0, 1, 1.05], [1, 0, 1.05], [1.05, 1.05, 0]])
    tree = linkage.merges(d, "uc")
    assert tree[1][2] < tree[0][2]
    assert linkage.cut(3, tree, 2).tolist() == [0, 0, 1]


def test_squared_and_top_groups():
    d = matrix(8, 1)
    tree = linkage.merges(d, "uc", squared=True)
    assert tree[0][2] == pytest.approx(d[np.tril_indices(8, -1)].min())
    top = linkage.cophenetic(8, tree, 3)
    labels = linkage.cut(8, tree, 3)
    assert (top[labels[:, None] == labels] == 0).all() and (top[labels[:, None] != labels] > 0).all()


def test_ties_take_the_smallest_pair():
    assert linkage.merges(np.ones((4, 4)), "sl")[0][:2] == (0, 1)
