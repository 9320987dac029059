"""Clusterings of points in space, and their distance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ground_distance
from ..kernels import transport
from ..session import written
from .running import running_sums


def points_of(coordinates: DataFrame) -> DataFrame:
    """locality and point (latitude, longitude)."""
    return coordinates.select("locality", F.array("latitude", "longitude").alias("point"))


def clusterify(labelled: DataFrame, keys: Sequence[str], label: str = "label", name: str = "locality", point: str = "point") -> DataFrame:
    """keys, label and points (in order of name) of each cluster."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(point).alias("p"))))
    return labelled.groupBy(*keys, label).agg(F.transform(rows, lambda x: x["p"]).alias("points"))


def centroids(labelled: DataFrame, keys: Sequence[str], label: str = "label", point: str = "point", width: int = 2) -> DataFrame:
    """keys, label and centroid, the mean of the cluster's points in each of `width` coordinates."""
    return labelled.groupBy(*keys, label).agg(F.array(*[F.avg(F.col(point)[i]) for i in range(width)]).alias("centroid"))


def line_costs(predicted: DataFrame, reference: DataFrame, keys: Sequence[str] = (), circle: bool = False) -> DataFrame:
    """keys, i, j and cost: what transport between each predicted(keys, label, x) cluster i and reference(label, x)
    cluster j costs, masses uniform. On a line that is the area between their distribution functions F and G. On a circle
    (places from 0 to under 1) of one direction, where going from x to y costs mod(x - y, 1), it is the area of F - G
    under its maximum, which fixes how much passes 0.

    Equal places are summed first, into one row with the mass that each cluster has there; labels, and not points,
    come to the driver; without points on a side there are no rows. Distribution functions are running sums over ranges of places, so that a cluster may hold any
    share of the points, and all pairs of clusters are added up from the same rows.
    """
    keys = list(keys)
    left, right = ([r[0] for r in df.select("label").distinct().orderBy("label").collect()] for df in (predicted, reference))
    if not left or not right:
        return predicted.limit(0).select(*keys, F.col("label").alias("i"), F.col("label").alias("j"), F.lit(0.0).alias("cost"))
    groups = predicted.select(F.struct(*keys).alias("k")).distinct().agg(F.array_sort(F.collect_set("k")).alias("k")).first()["k"] if keys else []

    def masses(df: DataFrame, by: list[str], labels: list, name: str) -> DataFrame:
        names = {c: f"__{c}" for c in [*by, "label"]}
        sizes = df.groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(F.count("*").alias("__n"))
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
        met = df.join(sizes, same).select(*by, "x", "label", (F.lit(1.0) / F.col("__n")).alias("__w"))
        return met.groupBy(*by, "x").agg(*[F.sum(F.when(F.col("label").eqNullSafe(F.lit(v)), F.col("__w"))).alias(f"__{name}{i}") for i, v in enumerate(labels)])

    mine, other = masses(predicted, keys, left, "p"), masses(reference, [], right, "q")
    if keys:
        every = F.array(*[F.struct(*[F.lit(g[c]).alias(c) for c in keys]) for g in groups])
        other = other.withColumn("__k", F.explode(every)).select("*", "__k.*").drop("__k")
    each = [f"__{name}{i}" for name, labels in (("p", left), ("q", right)) for i in range(len(labels))]
    places = mine.unionByName(other, allowMissingColumns=True).groupBy(*keys, "x").agg(*[F.sum(c).alias(c) for c in each])
    summed = running_sums(places, keys, ["x"], {f"{c}_": F.col(c) for c in each}, following="__next")
    step = F.coalesce(F.col("__next") - F.col("x"), F.lit(0.0))
    parts = [F.max(f"__p{i}_").alias(f"__has{i}") for i in range(len(left))]
    for i in range(len(left)):
        for j in range(len(right)):
            apart = F.col(f"__p{i}_") - F.col(f"__q{j}_")
            cost = F.greatest(F.max(apart), F.lit(0.0)) - F.sum(apart * step) if circle else F.sum(F.abs(apart) * step)
            parts.append(cost.alias(f"__c{i}_{j}"))
    made = summed.groupBy(*keys).agg(*parts)
    cells = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"__c{i}_{j}").alias("cost"), F.col(f"__has{i}").alias("has")) for i, a in enumerate(left) for j, b in enumerate(right)])
    return made.select(*keys, F.explode(cells).alias("c")).filter("c.has > 0").select(*keys, "c.i", "c.j", "c.cost")


def transport_plans(left: DataFrame, right: DataFrame, keys: Sequence[str], metric: str = "euclidean") -> DataFrame:
    """keys, kind, a, b and value of the cheapest transport from left(keys, name, point) to right(keys, name, point) in each
    group, masses uniform: `flow` rows with what goes from a to b, and the potentials of each a (`left`) and b
    (`right`), which prove it (see certificates). A group is one problem, which a task solves."""
    keys = list(keys)
    kinds = dict(left.select(*keys, "name").dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], f"kind string, a {kinds['name']}, b {kinds['name']}, value double"])

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x, y = x.sort_values("name"), y.sort_values("name")
        if not len(x) or not len(y):
            raise ValueError("a problem has points on one side only")
        moved, u, v = transport.optimum([1 / len(x)] * len(x), [1 / len(y)] * len(y), transport.ground_costs(np.stack(x["point"]), np.stack(y["point"]), metric))
        a, b = x["name"].tolist(), y["name"].tolist()
        rows = [("flow", a[i], b[j], f) for i, j, f in transport.flow_triples(moved)]
        rows += [("left", n, None, float(w)) for n, w in zip(a, u, strict=True)] + [("right", None, n, float(w)) for n, w in zip(b, v, strict=True)]
        made = pd.DataFrame(rows, columns=["kind", "a", "b", "value"], dtype=object)
        for c in reversed(keys):
            made.insert(0, c, x[c].iloc[0])
        return made

    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, where both come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def certificates(plans: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str], metric: str = "euclidean") -> DataFrame:
    """keys and what proves a plan of transport_plans cheapest, from the plan and the points alone: cost (of the flow),
    short (how far the mass that leaves or reaches a point is from the point's, at most), over (by how much two potentials
    exceed their points' distance, at most) and gap (cost less what the potentials are worth). Flow that is whole, potentials
    that nowhere exceed the distance and no gap: by duality nothing is cheaper."""
    keys = list(keys)

    def side(df: DataFrame, x: str, kind: str) -> DataFrame:
        sizes = df.groupBy(*keys).agg((F.lit(1.0) / F.count("*")).alias("mass"))
        worth = plans.filter(F.col("kind") == kind).select(*keys, F.col(x).alias("name"), F.col("value").alias(f"worth_{x}"))
        return df.join(sizes, keys).join(worth, [*keys, "name"]).select(*keys, F.col("name").alias(x), F.col("point").alias(f"point_{x}"), F.col("mass").alias(f"mass_{x}"), f"worth_{x}")

    # Steps are written, so that no task holds the sorts and maps of all joins at once.
    a, b = written(side(left, "a", "left"), "left"), written(side(right, "b", "right"), "right")
    flow = plans.filter("kind = 'flow'").select(*keys, "a", "b", F.col("value").alias("moved"))
    # Pairs of points go from the join into the aggregate; only the flow's, fewer than points, are joined by their names.
    away = ground_distance(F.col("point_a"), F.col("point_b"), metric)
    over = a.join(b, keys).groupBy(*keys).agg(F.max(F.col("worth_a") + F.col("worth_b") - away).alias("over"))
    carried = flow.join(a, [*keys, "a"]).join(b, [*keys, "b"]).groupBy(*keys).agg(F.sum(F.col("moved") * away).alias("cost"))
    over = written(written(over, "over").join(carried, keys, "left").fillna(0.0, ["cost"]), "over")

    def margins(df: DataFrame, x: str) -> DataFrame:
        met = df.join(flow.groupBy(*keys, x).agg(F.sum("moved").alias("moved")), [*keys, x], "left").fillna(0.0, ["moved"])
        return met.groupBy(*keys).agg(F.max(F.abs(F.col("moved") - F.col(f"mass_{x}"))).alias(f"short_{x}"), F.sum(F.col(f"mass_{x}") * F.col(f"worth_{x}")).alias(f"value_{x}"))

    met = over.join(written(margins(a, "a"), "margins"), keys).join(written(margins(b, "b"), "margins"), keys)
    return met.select(*keys, "cost", F.greatest("short_a", "short_b").alias("short"), "over", (F.col("cost") - F.col("value_a") - F.col("value_b")).alias("gap"))


def outer_cdistances(costs: DataFrame, p: DataFrame, q: DataFrame, keys: Sequence[str], out: str = "CDistance") -> DataFrame:
    """keys and the distance of two clusterings from costs(keys, i, j, cost) and the clusters' weights p(keys, label,
    weight) and q(label, weight): a group has as many rows as pairs of clusters. Null where the naive cost is 0."""
    keys = list(keys)
    met = costs.join(p.select(*keys, F.col("label").alias("i"), F.col("weight").alias("__p")), [*keys, "i"]).join(q.select(F.col("label").alias("j"), F.col("weight").alias("__q")), "j")
    kinds = dict(costs.select(*keys).dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot(index="i", columns="j", values="cost").to_numpy()
        left, right = frame.groupby("i")["__p"].first().to_numpy(), frame.groupby("j")["__q"].first().to_numpy()
        naive = float(left @ table @ right)
        value = transport.emd(left, right, table) / naive if naive else None
        return pd.DataFrame({**{c: [frame[c].iloc[0]] for c in keys}, out: [value]}).astype({out: "float64"})

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], f"{out} double"])
    found = met.groupBy(*keys).applyInPandas(run, schema)
    return found.withColumn(out, F.when(~F.isnan(out), F.col(out)))


def cluster_weights(labelled: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """keys, label, size and weight, the cluster's share of its group's points."""
    sizes = labelled.groupBy(*keys, label).agg(F.count("*").alias("size"))
    return sizes.withColumn("weight", F.col("size") / F.sum("size").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))))


def cdistances(predicted: DataFrame, reference: DataFrame, points: DataFrame, keys: Sequence[str], metric: str | Callable = "euclidean", out: str = "CDistance") -> DataFrame:
    """keys and the distance of each group of predicted(keys, locality, label) to reference(locality, label) over
    points(locality, point). A locality that one of the tables lacks is an error; null where the naive cost is 0."""
    keys = list(keys)
    right = reference.select("locality", F.col("label").alias("__gold")).join(points.select("locality", "point"), "locality", "full")
    met = predicted.select(*keys, "locality", "label").join(right, "locality", "left")
    kinds = dict(predicted.select(*keys).dtypes)
    expected = reference.count()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) != expected or frame["point"].isna().any() or frame["__gold"].isna().any():
            raise ValueError(f"{len(frame)} localities don't match the reference's {expected}")
        frame = frame.sort_values("locality")
        at = frame["point"].tolist()
        d = transport.cdistance(transport.clusterify(at, frame["label"]), transport.clusterify(at, frame["__gold"]), metric)
        return pd.DataFrame({**{c: [frame[c].iloc[0]] for c in keys}, out: [d]}).astype({out: "float64"})

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], f"{out} double"])
    found = met.groupBy(*keys).applyInPandas(run, schema)
    return found.withColumn(out, F.when(~F.isnan(out), F.col(out)))
