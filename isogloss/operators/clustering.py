"""Agglomerative clustering of many matrices at once: one group of rows for each matrix and method."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import linkage


def cluster(cells: DataFrame, k: int = 4, methods: Sequence[str] = linkage.METHODS, keys: Sequence[str] = ("model", "layer"), squared: bool = False, max_groups: int | None = None) -> DataFrame:
    """kind (merge, coph or cut) and its columns for each matrix and method, in one pass.

    merge: step, a, b (smallest members' labels), height, size. coph: a, b, height for all ordered pairs and the
    diagonal. cut: a, label of k groups. Labels are in code-point order; the lower triangle counts. A matrix with a
    missing cell is an error. A group is one matrix, whose size is that of the label set.
    """
    keys = list(keys)
    every = F.explode(F.array(*[F.lit(m) for m in methods]))
    rows = cells.select(*keys, F.col("row_loc").cast("string").alias("row_loc"), F.col("col_loc").cast("string").alias("col_loc"), "dist").withColumn("method", every)
    kinds = dict(cells.select(*keys).dtypes)
    head = "".join(f"{c} {kinds[c]}, " for c in keys)
    schema = f"{head}method string, kind string, step int, a string, b string, height double, size int, label int"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(frame["row_loc"]))
        at = {n: i for i, n in enumerate(names)}
        d = np.full((len(names), len(names)), np.nan)
        d[frame["row_loc"].map(at), frame["col_loc"].map(at)] = frame["dist"]
        if np.isnan(d[np.tril_indices(len(names), -1)]).any():
            raise ValueError("a distance is missing")
        method = frame["method"].iloc[0]
        tree = linkage.merges(d, method, squared)
        coph, labels = linkage.cophenetic(len(names), tree, max_groups), linkage.cut(len(names), tree, k)
        out = [("merge", s, names[a], names[b], h, n, None) for s, (a, b, h, n) in enumerate(tree)]
        out += [("coph", None, x, y, coph[i, j], None, None) for i, x in enumerate(names) for j, y in enumerate(names)]
        out += [("cut", None, x, None, None, None, int(labels[i])) for i, x in enumerate(names)]
        made = pd.DataFrame(out, columns=["kind", "step", "a", "b", "height", "size", "label"])
        made = made.astype({"step": "Int32", "size": "Int32", "label": "Int32", "height": "float64"})
        made.insert(0, "method", method)
        for c in reversed(keys):
            made.insert(0, c, frame[c].iloc[0])
        return made

    return rows.groupBy(*keys, "method").applyInPandas(run, schema)


def merge_rows(clustered: DataFrame) -> DataFrame:
    return clustered.filter("kind = 'merge'").drop("kind", "label")


def cophenetic_rows(clustered: DataFrame) -> DataFrame:
    return clustered.filter("kind = 'coph'").drop("kind", "step", "size", "label").withColumnsRenamed({"a": "row_loc", "b": "col_loc", "height": "coph"})


def partition_rows(clustered: DataFrame) -> DataFrame:
    return clustered.filter("kind = 'cut'").drop("kind", "step", "b", "height", "size").withColumnRenamed("a", "locality")
