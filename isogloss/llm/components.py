"""Connected components of a links table: local contraction where the links left fit one task, and alternating
large-star and small-star rounds until they do or nothing changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written

#: Links that one task holds, at most (about 200 bytes each).
LOCAL_LINKS = 1_000_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that aren't the smallest of their component, and that one."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))
    for a, b in zip(place[: len(u)].tolist(), place[len(u) :].tolist(), strict=True):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)
    for i, p in enumerate(parent):  # parents are smaller, so they are roots already
        parent[i] = parent[p]
    root = nodes[np.array(parent, np.int64)] if len(nodes) else nodes
    return nodes[nodes != root], root[nodes != root]


def _contracted(edges: DataFrame) -> DataFrame:
    """Each partition's links, about LOCAL_LINKS at a time, as stars."""
    most = LOCAL_LINKS

    def star(frames: list[pd.DataFrame]) -> pd.DataFrame:
        held = pd.concat(frames)
        u, v = contract(held["u"].to_numpy(np.int64), held["v"].to_numpy(np.int64))
        return pd.DataFrame({"u": u, "v": v})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size > most:
                yield star(held)
                held, size = [], 0
        if held:
            yield star(held)

    return edges.mapInPandas(run, "u long, v long")


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    met = large.join(least, "u")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that links reach) for every node of links(a, b).

    Direction, repeated links and links of a node with itself don't matter; rows with a null end are ignored; an
    empty table gives an empty result. Each round is a written table of the shared folder; the last one's files can be
    discarded with the result.
    """
    ends = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = written(ends.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct(), "edges")
    # A task gives a row for each of its nodes, so tasks must hold many links: those that made them would each repeat
    # the nodes of a large group.
    if (tasks := -(-edges.count() // LOCAL_LINKS)) > 1:
        old, edges = edges, written(_contracted(edges.coalesce(tasks)), "edges")
        discard(old)
    before = None
    while True:
        few = edges.count() <= LOCAL_LINKS
        old, edges = edges, written(_contracted(edges.coalesce(1)) if few else _stars(edges), "edges")
        discard(old)
        if few:
            break
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    own = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
    out.written_path = edges.written_path
    return out
