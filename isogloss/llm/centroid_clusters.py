"""Centroid clustering (operator 11): Lloyd's rounds with Drake's adaptive bounds, exact in whole numbers.

Each vector keeps its centroid and the few that were next nearest, with an upper bound of the distance to the first,
a lower bound for each of the others and one remainder bound for all centroids that aren't listed. When centroids
move, bounds are widened by how far (the remainder by the farthest move). Where the upper bound lies below all lower
ones from some place on, only the centroids before that place can be nearest, and only these are measured. Where it
lies below none, the ordering can't be certified, and all centroids are rescanned. How many are listed is adapted: when
no vector of a round needed more, lists are cut, and what is cut falls under the remainder bound.

Bounds are distances in floating point, rounded outwards and compared strictly; distances that decide are sums of
squares of whole numbers, ties go to the smaller centroid. So the result is that of full scans.

A round is one pass over the table of vectors with their bounds, which writes the next one. Beside it a task reports
only by how much the sums of centroids change because of the vectors that moved; reports are summed by Spark and only
the centroids come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written
from .arrow_text import bounded_batches
from .vectors import finite, lists, matrix, mean_floor, rows_of, squared, whole

#: Centroids, rounds, components of a vector, what these are multiplied by, and the name of the first draw.
CENTROIDS, ROUNDS, WIDTH, SCALE, SEED = 8, 10, 64, 1024, 3
#: Vectors that a kernel has at once.
ROWS = 8192

_UP, _DOWN = np.inf, -np.inf
#: kind 0: a vector with its centroids (`near`, the first is its own) and bounds (upper, lower ones, remainder); kind 1:
#: a report: for cluster near[0], `x` is to be added to its sum, `id` to its count, and bound[0] places were looked at.
_STATE = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("x", pa.list_(pa.int64())), ("near", pa.list_(pa.int32())), ("bound", pa.list_(pa.float64())), ("distance", pa.int64())])
_DDL = "kind byte, id long, x array<long>, near array<int>, bound array<double>, distance long"


def _root(d2: np.ndarray, way: float) -> np.ndarray:
    return np.nextafter(np.sqrt(d2.astype(np.float64)), way)


def scan(x: np.ndarray, centres: np.ndarray, listed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector the nearest centroid and the `listed` next ones, their bounds, and the nearest's distance."""
    d2 = np.stack([squared(x, c) for c in centres], 1)
    order = np.argsort(d2, 1, kind="stable")  # ties to the smaller centroid
    near = order[:, : listed + 1]
    sorted_d2 = np.take_along_axis(d2, order, 1)
    rest = _root(sorted_d2[:, listed + 1], _DOWN) if len(centres) > listed + 1 else np.full(len(x), np.inf)
    bound = np.column_stack([_root(sorted_d2[:, 0], _UP), _root(sorted_d2[:, 1 : listed + 1], _DOWN), rest])
    return near, bound, sorted_d2[:, 0]


def step(x: np.ndarray, near: np.ndarray, bound: np.ndarray, centres: np.ndarray, moved: np.ndarray, listed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """near, bound and exact distance of each vector after centroids have moved by `moved` (upper bounds) to `centres`,
    how many places the vector that needed most needed, and how many were rescanned."""
    near, bound = near.copy(), bound.copy()
    bound[:, 0] = np.nextafter(bound[:, 0] + moved[near[:, 0]], _UP)
    bound[:, 1:-1] = np.nextafter(bound[:, 1:-1] - moved[near[:, 1:]], _DOWN)
    bound[:, -1] = np.nextafter(bound[:, -1] - moved.max(initial=0), _DOWN)
    # The least lower bound from each place on.
    beyond = np.minimum.accumulate(bound[:, :0:-1], axis=1)[:, ::-1]
    # The distance to the own centroid is a result, so that the upper bound is tight.
    own = squared(x, centres[near[:, 0]])
    bound[:, 0] = _root(own, _UP)
    certain = bound[:, :1] < beyond
    need = np.where(certain.any(1), certain.argmax(1), -1)  # listed ones that may be nearer; -1: all centroids may
    for z in range(1, int(need.max(initial=0)) + 1):
        rows = np.flatnonzero(need == z)
        if len(rows):
            names = near[rows, : z + 1]
            d2 = np.stack([own[rows], *[squared(x[rows], centres[names[:, k]]) for k in range(1, z + 1)]], 1)
            order = np.lexsort((names, d2), axis=1)
            d2 = np.take_along_axis(d2, order, 1)
            near[rows, : z + 1] = np.take_along_axis(names, order, 1)
            bound[rows, 0], bound[rows, 1 : z + 1], own[rows] = _root(d2[:, 0], _UP), _root(d2[:, 1:], _DOWN), d2[:, 0]
    rows = np.flatnonzero(need < 0)
    if len(rows):
        near[rows], bound[rows], own[rows] = scan(x[rows], centres, near.shape[1] - 1)
    if listed < near.shape[1] - 1:
        bound = np.column_stack([bound[:, : listed + 1], bound[:, listed + 1 :].min(1)])
        near = near[:, : listed + 1]
    return near, bound, own, int(need.max(initial=0)), len(rows)


def _report(changes: dict[int, tuple[int, np.ndarray]], most: int) -> pa.RecordBatch:
    names = sorted(changes)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([1] * len(names), pa.int8()),
            pa.array([changes[j][0] for j in names], pa.int64()),
            pa.array([changes[j][1].tolist() for j in names], _STATE.field("x").type),
            pa.array([[j] for j in names], _STATE.field("near").type),
            pa.array([[float(most)] for _ in names], _STATE.field("bound").type),
            pa.array([None] * len(names), pa.int64()),
        ],
        schema=_STATE,
    )


def _pass(rows: DataFrame, centres: np.ndarray, moved: np.ndarray | None, listed: int, scale: int) -> DataFrame:
    """The state after assigning to centres, from vectors (first pass, without `moved`) or from the last state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, most = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64), listed if moved is None else 0
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                if moved is None:
                    x = whole(matrix(batch.column(1)), scale)
                    near, bound, own = scan(x, centres, listed)
                    before = None
                else:
                    x, before = matrix(batch.column(1), np.int64), matrix(batch.column(2), np.int64)
                    near, bound, own, z, rescanned = step(x, before, matrix(batch.column(3)), centres, moved, listed)
                    most, before = max(most, before.shape[1] - 1 if rescanned else z), before[:, 0]
                changed = np.arange(len(x)) if before is None else np.flatnonzero(before != near[:, 0])
                for names, sign in ((near[changed, 0], 1), *([] if before is None else [(before[changed], -1)])):
                    np.add.at(count, names, sign)
                    np.add.at(sums, names, sign * x[changed])
                kind = pa.array(np.zeros(len(x), np.int8))
                yield pa.RecordBatch.from_arrays([kind, batch.column(0), lists(x, pa.int64()), lists(near, pa.int32()), lists(bound, pa.float64()), pa.array(own)], schema=_STATE)
        # A task says how many places it needed even where nothing has moved.
        changes = {j: (int(count[j]), sums[j]) for j in range(len(centres)) if j == 0 or count[j] or sums[j].any()}
        yield _report(changes, most)

    return rows.mapInArrow(run, _DDL)


def _reported(state: DataFrame, width: int) -> tuple[dict[int, tuple[int, list[int]]], int]:
    """What reports add to each centroid's count and sum, and the most places needed; only these columns' reports are
    read, and as many rows as centroids have components come to the driver."""
    told = state.filter("kind = 1").select(F.col("near")[0].alias("j"), F.col("bound")[0].alias("most"), F.posexplode(F.concat(F.array("id"), "x")).alias("i", "v"))
    changes: dict[int, list[int]] = {}
    needed = 0.0
    for r in told.groupBy("j", "i").agg(F.sum("v").alias("v"), F.max("most").alias("most")).collect():
        changes.setdefault(r["j"], [0] * (width + 1))[r["i"]] = r["v"]
        needed = max(needed, r["most"])
    return {j: (v[0], v[1:]) for j, v in changes.items()}, int(needed)


def centroid_digest(centre) -> str:
    return hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared, to the cluster's centroid), cluster_inertia and inertia (distances summed
    over the cluster and over all), centroid_sha256 and centroid (array<long>), one row per vector that takes part.

    Those are vectors with exactly `width` components, none null or non-finite, each turned into floor(scale * x).
    Centroids start as the k with the smallest sha256 of `seed:id`; after each round centroids are the componentwise
    floor of their vectors' mean, and a centroid without vectors stays.

    Repeated rows each count, and fare alike; of rows with one id the smaller vector is the first centroid. A null id
    takes part, and starts a centroid only after all others. With fewer than k vectors there are as many centroids; an
    empty table gives an empty result. Components over 2**27 after scaling are an error, as their distances would not
    fit. Other columns are not read. Only the centroids, their counts and their sums come to the driver.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = rows_of(vectors, id_col, vec_col).filter(finite(F.col("v")) & (F.size("v") == width))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(name.asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    centres = whole(np.array([r["v"] for r in first], np.float64).reshape(-1, width), scale)
    k = len(centres)
    least = max(1, k // 8)
    listed = min(k - 1, max(least, -(-k // 4) + 1))  # Drake's start is a quarter; one more while centroids still move far
    state = written(_pass(rows, centres, None, listed, scale), "bounds")
    counts, sums = [0] * k, [[0] * width for _ in range(k)]
    for _ in range(rounds):
        changes, most = _reported(state, width)
        for j, (n, x) in changes.items():
            counts[j] += n
            sums[j] = [a + b for a, b in zip(sums[j], x, strict=True)]
        new = np.array([mean_floor(s, n) if n else c.tolist() for s, n, c in zip(sums, counts, centres, strict=True)], np.int64)
        moved = _root(squared(new, centres), _UP)
        moved[(new == centres).all(1)] = 0.0
        after = min(listed, max(least, most))
        vectors_only = state.filter("kind = 0").select("id", "x", "near", "bound")
        following = written(_pass(vectors_only, new, moved, after, scale), "bounds")
        discard(state)
        state, centres, listed = following, new, after
    done = state.filter("kind = 0").select(F.col("id").alias("vec_id"), F.col("near")[0].alias("cluster"), "distance")
    totals = {r["cluster"]: r["d"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    # As many rows as centroids.
    named = spark.createDataFrame([(j, totals.get(j, 0), sum(totals.values()), centroid_digest(c), c) for j, c in enumerate(centres.tolist())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return done.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
