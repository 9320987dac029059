"""Single linkage of matrices that no task has to hold: minimum spanning trees by rounds of least edges."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written


def _roots(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part and root from each component's choice (part, other): choices lead to a pair that chose each other, whose
    smaller name is the root. Pointers are doubled until they all end there."""
    back = chosen.select(*keys, F.col("part").alias("other"), F.col("other").alias("again"))
    mutual = (F.col("again") == F.col("part")) & (F.col("part") < F.col("other"))
    pointers = written(chosen.select(*keys, "part", "other").join(back, [*keys, "other"]).select(*keys, "part", F.when(mutual, F.col("part")).otherwise(F.col("other")).alias("root")), "pointers")
    while True:
        beyond = pointers.select(*keys, F.col("part").alias("root"), F.col("root").alias("next"))
        further = written(pointers.join(beyond, [*keys, "root"]).select(*keys, "part", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "pointers")
        discard(pointers)
        if not further.filter("moved").limit(1).count():
            return further
        pointers = written(further.drop("moved"), "pointers")
        discard(further)


def spanning_edges(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, a, b and dist of the edges of each matrix's minimum spanning tree, of equal edges the one with the smaller
    (a, b). cells: keys, row_loc, col_loc, dist, in any triangle or both; a missing distance is no edge.

    A round joins each component by its least edge to another one, an aggregate over all edges that still lead somewhere;
    components at least halve, so that there are as many rounds as a matrix's labels have binary digits.
    """
    keys = list(keys)
    a, b = F.least("row_loc", "col_loc").cast("string"), F.greatest("row_loc", "col_loc").cast("string")
    edges = cells.filter("row_loc <> col_loc and dist is not null").groupBy(*keys, a.alias("a"), b.alias("b")).agg(F.min("dist").alias("dist"))
    edges = written(edges.withColumns({"x": F.col("a"), "y": F.col("b")}), "edges")
    tree: list[DataFrame] = []
    while edges.limit(1).count():
        ends = F.explode(F.array(F.struct(F.col("x").alias("part"), F.col("y").alias("other")), F.struct(F.col("y").alias("part"), F.col("x").alias("other"))))
        least = edges.withColumn("e", ends).groupBy(*keys, F.col("e.part").alias("part")).agg(F.min(F.struct("dist", "a", "b", "e.other")).alias("m"))
        chosen = written(least.select(*keys, "part", "m.dist", "m.a", "m.b", "m.other"), "chosen")
        roots = _roots(chosen, keys)
        tree.append(chosen.select(*keys, "a", "b", "dist").distinct())
        left, right = (roots.select(*keys, F.col("part").alias(c), F.col("root").alias(f"{c}_root")) for c in ("x", "y"))
        further = edges.join(left, [*keys, "x"]).join(right, [*keys, "y"]).filter("x_root <> y_root")
        following = written(further.select(*keys, "a", "b", "dist", F.col("x_root").alias("x"), F.col("y_root").alias("y")), "edges")
        discard(edges)
        discard(roots)
        edges = following
    out = edges.select(*keys, "a", "b", "dist")
    for part in tree:
        out = out.unionByName(part)
    return out


def single_linkage(tree: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, step, a, b (the clusters' smallest labels), height and size of the merges of single linkage, from the edges
    of spanning trees. A group has as many rows as a matrix has labels, less one."""
    keys = list(keys)
    kinds = dict(tree.select(*keys).dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], "step int, a string, b string, height double, size int"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        above: dict[str, str] = {}
        size: dict[str, int] = {}

        def root(x: str) -> str:
            while above.get(x, x) != x:
                above[x] = above.get(above[x], above[x])
                x = above[x]
            return x

        out = []
        for n, (height, x, y) in enumerate(sorted(zip(frame["dist"], frame["a"], frame["b"], strict=True))):
            x, y = sorted((root(x), root(y)))
            above[y] = x
            size[x] = size.get(x, 1) + size.get(y, 1)
            out.append((n, x, y, float(height), size[x]))
        made = pd.DataFrame(out, columns=["step", "a", "b", "height", "size"])
        for c in reversed(keys):
            made.insert(0, c, frame[c].iloc[0])
        return made

    return tree.groupBy(*keys).applyInPandas(run, schema)
