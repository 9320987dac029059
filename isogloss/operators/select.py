"""Choosing rows by their group's best value."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import not_a_number_to_null


def pearson(pairs: DataFrame, keys: Sequence[str], a: str, b: str, out: str = "r") -> DataFrame:
    """Correlation for each group over all its rows; null where a side has no variance. Rows with a null don't count."""
    both = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return both.groupBy(*keys).agg(r.alias(out))


def best_with_ties(df: DataFrame, keys: Sequence[str], value: str, largest: bool = True, out: str = "is_best") -> DataFrame:
    """df with a mark on every row that has its group's best value; null and NaN never win.

    The best values are an aggregate, which is partial before it is shuffled, and are joined back, so that a group
    may hold any share of the rows."""
    v = not_a_number_to_null(F.col(value).cast("double"))
    names = [f"__key{i}" for i in range(len(keys))]
    best = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg((F.max(v) if largest else F.min(v)).alias("__best"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], F.lit(True))
    return df.join(best, same, "left").withColumn(out, F.coalesce(v == F.col("__best"), F.lit(False))).drop(*names, "__best")


def first_best(df: DataFrame, keys: Sequence[str], order) -> DataFrame:
    """The first row of each group in the order given."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(own)).filter("__n = 1").drop("__n")


def marked(df: DataFrame, flag: str = "is_best", out: str = "max_r") -> DataFrame:
    """df with X for flagged rows and an empty text for the others, in place of the flag."""
    return df.withColumn(out, F.when(F.col(flag), "X").otherwise("")).drop(flag)


def of_winners(df: DataFrame, winners: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of df that belong to a winner."""
    return df.join(winners.select(*keys), list(keys), "left_semi")
