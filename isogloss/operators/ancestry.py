"""Cophenetic distances of trees of any size, from merges alone: leaves are numbered so that every cluster is an interval,
and a pair's first common cluster is the last merge in the interval between the two."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written


def leaf_positions(merges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, label, pos (from 0), step and height for each label of each tree. Every cluster's labels have adjacent places,
    and step and height are those of the merge that put a label's cluster behind the one before it (null at place 0).

    merges: keys, step, a, b (smallest labels of the clusters that merge, of which a stays as the name), height, size. A
    cluster's place is that of the cluster that takes it in, and as many places further as that one had members; these
    sums along the ways to the root are made by pointers that double, so that rounds are as many as the binary digits of
    the deepest way. Trees without a merge have no labels here.
    """
    keys = list(keys)
    # Sizes of clusters only grow, so the largest is the one with which a name goes into another cluster.
    own = merges.groupBy(*keys, F.col("a").alias("label")).agg(F.max("size").alias("own"))
    inner = merges.select(*keys, F.col("b").alias("label"), F.col("a").alias("up"), "step", "height", "size")
    met = own.join(inner, [*keys, "label"], "full")
    shift = F.when(F.col("up").isNotNull(), F.col("size") - F.coalesce("own", F.lit(1))).otherwise(0).cast("long")
    ways = written(met.select(*keys, "label", "step", "height", "up", shift.alias("pos")), "ways")
    while ways.filter("up is not null").limit(1).count():
        # Only rows that aren't at the root yet need what they point to; a row that many point to is one row.
        beyond = ways.select(*keys, F.col("label").alias("up"), F.col("up").alias("__next"), F.col("pos").alias("__more"))
        moved = ways.filter("up is not null").join(beyond, [*keys, "up"]).select(*keys, "label", "step", "height", F.col("__next").alias("up"), (F.col("pos") + F.col("__more")).alias("pos"))
        following = written(ways.filter("up is null").unionByName(moved), "ways")
        discard(ways)
        ways = following
    return ways.drop("up")


def cophenetic_heights(pairs: DataFrame, merges: DataFrame, keys: Sequence[str], out: str = "coph") -> DataFrame:
    """pairs (keys, row_loc, col_loc and any other columns) with the height of the merge that first joins the two: 0 for a
    label and itself, null where a label is in no merge.

    Between two places the merge with the greatest step is the one that joins them. Greatest ones of stretches of 1, 2,
    4, ... places are made by doubling (places times digits rows in all), and a pair looks at the two stretches that cover
    its interval: equi-joins only, whatever pairs are asked for, and no array of a tree's pairs in any task.
    """
    keys = list(keys)
    placed = leaf_positions(merges, keys)
    level = written(placed.filter("step is not null").select(*keys, F.col("pos").alias("start"), F.struct("step", "height").alias("last")), "stretches")
    digits = max(0, (merges.agg(F.max("size")).first()[0] or 1) - 1).bit_length()
    table = level.withColumn("digit", F.lit(0))
    for digit in range(1, digits):
        right = level.select(*keys, (F.col("start") - (1 << (digit - 1))).alias("start"), F.col("last").alias("__right"))
        level = written(level.join(right, [*keys, "start"]).select(*keys, "start", F.greatest("last", "__right").alias("last")), "stretches")
        table = table.unionByName(level.withColumn("digit", F.lit(digit)))
    at = pairs
    for side, name in (("row_loc", "__x"), ("col_loc", "__y")):
        at = at.join(placed.select(*keys, F.col("label").alias(side), F.col("pos").alias(name)), [*keys, side], "left")
    low, high = F.least("__x", "__y") + 1, F.greatest("__x", "__y")
    # floor(log2) of the interval's length, by its binary digits.
    at = at.withColumn("digit", F.when(F.col("__x") != F.col("__y"), F.length(F.bin(high - low + 1)) - 1))
    long = F.expr("shiftleft(1L, digit)")
    at = at.withColumns({"__low": low, "__high": high - long + 1})
    for name in ("__low", "__high"):
        at = at.join(table.select(*keys, "digit", F.col("start").alias(name), F.col("last").alias(f"{name}_last")), [*keys, "digit", name], "left")
    height = F.greatest("__low_last", "__high_last")["height"]
    known = F.when(F.col("__x") == F.col("__y"), F.lit(0.0)).otherwise(height)
    return at.select(*[c for c in pairs.columns if c != out], known.alias(out))
