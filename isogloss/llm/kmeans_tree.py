"""Approximate nearest neighbours (operator 2): a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every row is indexed in the leaf that it descends to. A query keeps a
priority queue of tree nodes by the best inner product that they promise and visits leaves in that order. How many
leaves it visits is calibrated: leaves are added until the sample's queries reach the recall asked
for, and further ones until those visited hold as many rows as a query needs. Visited leaves are scanned exactly.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .arrow_text import bounded_batches

#: Rows that the tree is fitted on, about; rows that a leaf should have; children of a node; parts that the sample is to be
#: divided into at most, on average (k-means leaves are uneven, so that there may be a few times as many leaves).
SAMPLE, LEAF_ROWS, BRANCH, LEAVES = 16_384, 32, 8, 1024
#: Recall that calibration asks for on the sample, and the sample's queries that measure it.
RECALL, CALIBRATION = 0.95, 400
#: Distinct vectors, and queries, that one scan task holds.
BIN_ROWS, QUERY_ROWS = 16_384, 8_192


@dataclass
class Tree:
    """Nodes in breadth-first order; node 0 is the root. first_child is -1 for leaves, whose number is in leaf. visits:
    leaves that a query visits; sample_recall and share: the recall on the sample, and the share of its rows scanned."""

    centre: np.ndarray
    spread: np.ndarray
    first_child: np.ndarray
    children: np.ndarray
    leaf: np.ndarray
    leaves: int
    visits: int = 1
    sample_recall: float = 0.0
    share: float = 1.0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row descends to, always to the nearest centre."""
        node, out = np.zeros(len(x), np.int64), np.full(len(x), -1)
        active = np.arange(len(x))
        while len(active):
            done = self.first_child[node[active]] < 0
            out[active[done]] = self.leaf[node[active[done]]]
            active = active[~done]
            for n in np.unique(node[active]):
                rows = active[node[active] == n]
                c = self.centre[self.first_child[n] : self.first_child[n] + self.children[n]]
                node[rows] = self.first_child[n] + (x[rows] @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        return out

    def order(self, q: np.ndarray, visits: int, rows: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first `visits` leaves, best bin first, and further ones until they hold `least` of the leaves' rows."""
        promise = (self.centre @ q + np.sqrt(q @ q) * self.spread).tolist()
        queue, out, held = [(-promise[0], 0)], [], 0
        while queue and (len(out) < visits or held < least):
            _, n = heapq.heappop(queue)
            if self.first_child[n] < 0:
                out.append(int(self.leaf[n]))
                held += rows.get(out[-1], 0) if rows else 0
            else:
                for c in range(self.first_child[n], self.first_child[n] + self.children[n]):
                    heapq.heappush(queue, (-promise[c], c))
        return out


def _lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)[:, None]
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


def fit_tree(x: np.ndarray, leaf_rows: int, k: int, recall: float = RECALL, branch: int = BRANCH, seed: int = 7) -> Tree:
    """The tree of the sample x (leaves have about leaf_rows of its rows), calibrated for the k largest products."""
    rng = np.random.default_rng(seed)
    centre, spread, first, children, leaf, leaves = [], [], [], [], [], 0
    todo: list[np.ndarray] = [np.arange(len(x))]
    for rows in todo:
        part = x[rows]
        mean = part.mean(0) if len(rows) else np.zeros(x.shape[1])
        centre.append(mean)
        spread.append(np.sqrt(((part - mean) ** 2).sum(1).mean() / x.shape[1]) if len(rows) else 0.0)
        own = _lloyd(part, min(branch, len(rows)), rng) if len(rows) > 1.5 * leaf_rows else np.zeros(len(rows), int)
        groups = [rows[own == g] for g in np.unique(own)]
        if len(groups) > 1:
            first.append(len(todo))
            children.append(len(groups))
            leaf.append(-1)
            todo += groups
        else:
            first.append(-1)
            children.append(0)
            leaf.append(leaves)
            leaves += 1
    tree = Tree(np.array(centre), np.array(spread), np.array(first), np.array(children), np.array(leaf), leaves)
    calibrate(tree, x, k, recall, rng)
    return tree


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float, rng: np.random.Generator) -> None:
    """Sets visits: leaves are added, best bin first, until the sample's queries find `recall` of their k nearest."""
    if len(x) <= k + 1:
        tree.visits, tree.sample_recall = tree.leaves, 1.0
        return
    own, queries = tree.assign(x), rng.choice(len(x), min(CALIBRATION, len(x)), replace=False)
    hits, scanned, rows = np.zeros(tree.leaves), np.zeros(tree.leaves), np.bincount(own, minlength=tree.leaves)
    for q in queries:
        score = x @ x[q]
        score[q] = -np.inf
        near = np.argpartition(-score, k)[:k]
        place, order = np.empty(tree.leaves, int), tree.order(x[q], tree.leaves)
        place[order] = np.arange(tree.leaves)
        scanned += np.cumsum(rows[order])
        hits += np.bincount(place[own[near]], minlength=tree.leaves)
    reached = np.cumsum(hits) / (k * len(queries))
    tree.visits = min(tree.leaves, int(np.searchsorted(reached, recall)) + 1)
    tree.sample_recall = float(reached[tree.visits - 1])
    tree.share = float(scanned[tree.visits - 1] / (len(x) * len(queries)))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct id (long) and v (array<float>) of rows with an id whose vector is not null or zero, has no null or
    non-finite component and the most common length (the shorter of equally common ones)."""
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    # A null component or a NaN makes the test null or false.
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda c: F.abs(c) < float("inf")) & ~F.exists(v, F.isnan), F.lit(False)) & F.exists(v, lambda c: c != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (lengths[0]["n"] if lengths else 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def nearest(vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, and the same in each row: leaves (of the tree), visits (of a query),
    share (of the sample's rows that these hold) and sample_recall. For each row whose id satisfies `queries` (a function of the id
    column) its k nearest found among all other ids by largest inner product in double precision, nearest first,
    ties to the smaller id.

    Rows that are not usable (see usable()) take no part; a repeated row counts once; fewer candidates than k are
    all returned; an empty table gives an empty result; other columns are not read. Equal vectors are indexed once,
    with the k + 1 smallest of their ids, which are all that any query can need. The tree,
    its sample and the leaves' sizes come to the driver; rows and queries do not.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors, id_col, vec_col)
    by_vector = Window.partitionBy("v").orderBy("id")
    # The limit on ranks reaches below the shuffle, so that a vector that many rows share sends few of them.
    ranked = rows.distinct().withColumn("n", F.row_number().over(by_vector)).filter(F.col("n") <= k + 1)
    distinct = written(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "vectors")
    total = distinct.count()
    schema = "query_id long, rank int, vec_id long, score double, leaves int, visits int, share double, sample_recall double"
    if not total:
        return spark.createDataFrame([], schema)
    space = 1 << 40
    # About `sample` rows by a hash of the id, so that equal tables give equal trees.
    picked = distinct.filter(F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(space)) < F.lit(min(space, space * sample // total))).select("rep", "v").toPandas().sort_values("rep")
    x = _matrix(picked["v"]) if len(picked) else _matrix(distinct.orderBy("rep").select("v").limit(1).toPandas()["v"])
    leaf_rows = max(16, len(x) // LEAVES, round(LEAF_ROWS * len(x) / max(total, LEAF_ROWS)))
    shared = spark.sparkContext.broadcast(fit_tree(x, leaf_rows, k, recall))
    tree = shared.value

    def index(frames):
        for frame in frames:
            yield frame.assign(leaf=shared.value.assign(_matrix(frame["v"])).astype(np.int32))

    indexed = written(distinct.mapInPandas(index, "v array<double>, ids array<long>, rep long, leaf int"), "leaves")
    sizes = indexed.groupBy("leaf").agg(F.count("*").alias("vectors"), F.sum(F.size("ids")).alias("ids")).collect()
    counts, held = {r["leaf"]: r["vectors"] for r in sizes}, {r["leaf"]: r["ids"] for r in sizes}
    # Leaves lie in bins of BIN_ROWS rows; a leaf with more has several bins of its own.
    bins, at, room = {}, -1, 0
    for leaf in range(tree.leaves):
        n = counts.get(leaf, 0)
        if n > BIN_ROWS:
            parts = -(-n // BIN_ROWS)
            bins[leaf], at, room = (at + 1, parts), at + parts, 0
        else:
            if n > room or at < 0:
                at, room = at + 1, BIN_ROWS
            bins[leaf], room = (at, 1), room - n
    places = F.create_map(*[F.lit(v) for leaf, b in bins.items() for v in (leaf, b[0])])
    parts = F.create_map(*[F.lit(v) for leaf, b in bins.items() for v in (leaf, b[1])])

    wanted = rows.filter(queries(F.col("id")))
    asked = indexed.join(wanted.select("v").distinct(), "v", "left_semi").select("rep", "v")

    def plan(frames):
        own = shared.value
        for frame in frames:
            out = []
            for rep, v in zip(frame["rep"], frame["v"], strict=True):
                by_bin: dict[int, list[int]] = {}
                for leaf in own.order(np.asarray(v, np.float64), own.visits, held, k + 1):
                    first, count = bins[leaf]
                    for b in range(first, first + count):
                        by_bin.setdefault(b, []).append(leaf)
                out += [(b, rep, v, leaves) for b, leaves in by_bin.items()]
            yield pd.DataFrame(out, columns=["bin", "rep", "q", "visit"])

    planned = written(asked.mapInPandas(plan, "bin int, rep long, q array<double>, visit array<int>"), "queries")
    # A bin that many queries visit is sent once for each QUERY_ROWS of them, and one that none visits not at all.
    shares = planned.groupBy("bin").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).cast("int").alias("shares"))
    left = planned.join(shares, "bin").withColumn("share", F.pmod(F.xxhash64("rep"), F.col("shares")).cast("int")).drop("shares")
    right = indexed.withColumn("bin", places[F.col("leaf")] + F.pmod(F.xxhash64("rep"), parts[F.col("leaf")]).cast("int"))
    right = right.join(shares, "bin").select("bin", "leaf", "v", "ids", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))

    def scan(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(rows):
            rows = rows.sort_values("leaf", kind="stable").reset_index(drop=True)
            y, ids, q = _matrix(rows["v"]), rows["ids"].tolist(), _matrix(asked["q"])
            leaf = rows["leaf"].to_numpy()
            for lo in range(0, len(asked), 256):
                part = q[lo : lo + 256]
                score = part @ y.T
                for i, visit in enumerate(asked["visit"].iloc[lo : lo + 256]):
                    allowed = np.isin(leaf, visit)
                    score[i, ~allowed] = -np.inf
                    n = int(allowed.sum())
                    if not n:
                        continue
                    top = np.argpartition(-score[i], min(k + 1, len(y)) - 1)[: k + 1]
                    # Rows within rounding of the last one stay too; the exact order is made from the sums below.
                    edge = score[i, top].min()
                    top = np.flatnonzero((score[i] >= edge - 1e-9 * max(1.0, abs(edge))) & allowed)
                    exact = (y[top] * part[i]).sum(1)
                    best = sorted((-s, j) for s, ids_of in zip(exact.tolist(), top.tolist(), strict=True) for j in ids[ids_of])[: k + 1]
                    out.append((int(asked["rep"].iloc[lo + i]), [j for _, j in best], [-s for s, _ in best]))
        return pd.DataFrame(out, columns=["rep", "ids", "scores"])

    found = left.groupBy("bin", "share").cogroup(right.groupBy("bin", "share")).applyInPandas(scan, "rep long, ids array<long>, scores array<double>")
    best = F.array_sort(F.flatten(F.collect_list(F.transform(F.arrays_zip("ids", "scores"), lambda z: F.struct((-z["scores"]).alias("s"), z["ids"].alias("i"))))))
    lists = found.groupBy("rep").agg(F.slice(best, 1, k + 1).alias("best"))
    keys = indexed.select("v", "rep")
    ask = wanted.distinct().join(keys, "v").select(F.col("id").alias("query_id"), "rep").join(lists, "rep")
    kept = F.slice(F.filter("best", lambda b: b["i"] != F.col("query_id")), 1, k)
    out = ask.select("query_id", F.posexplode(kept).alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("score"), *[F.lit(v).alias(c) for c, v in (("leaves", tree.leaves), ("visits", tree.visits), ("share", tree.share), ("sample_recall", tree.sample_recall))])
