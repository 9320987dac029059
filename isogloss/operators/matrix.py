"""Labelled matrices in long form: row_loc, col_loc, dist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaffold(cells: DataFrame, labels: DataFrame, keys: Sequence[str] = ("model", "layer")) -> DataFrame:
    """A cell for each ordered pair of labels(locality) in each group, null where cells has none.

    The label table is a small dimension; its pairs are as many as a matrix has cells.
    """
    rows, columns = labels.select(F.col("locality").alias("row_loc")), labels.select(F.col("locality").alias("col_loc"))
    grid = rows.crossJoin(columns)
    if keys:
        grid = cells.select(*keys).distinct().crossJoin(grid)
    return grid.join(cells, [*keys, "row_loc", "col_loc"], "left")


def wide(cells: DataFrame, labels: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """One row per row label, one column per given label."""
    return cells.groupBy(*keys, "row_loc").pivot("col_loc", list(labels)).agg(F.first("dist"))


def long(matrix: DataFrame, keys: Sequence[str] = (), value: str = "dist") -> DataFrame:
    """Cells of a wide matrix; null cells are kept."""
    fixed = [*keys, "row_loc"]
    return matrix.unpivot(fixed, [c for c in matrix.columns if c not in fixed], "col_loc", value)


def without(cells: DataFrame, labels: Sequence) -> DataFrame:
    """The cells in neither row nor column of the labels. A label that is no row or no column is an error, when the
    result is read."""
    labels = list(labels)
    if not labels:
        return cells
    kept = cells.filter(~F.col("row_loc").isin(labels) & ~F.col("col_loc").isin(labels))
    # One row a label that has been found, at most, so an aggregate of all is as many numbers as there are labels.
    found = cells.agg(*[F.max(F.when(F.col(c) == label, 1)).alias(f"{c}{i}") for i, label in enumerate(labels) for c in ("row_loc", "col_loc")])
    missing = F.filter(F.array(*[F.when(F.col(f"row_loc{i}").isNull() | F.col(f"col_loc{i}").isNull(), F.lit(str(label))) for i, label in enumerate(labels)]), lambda x: x.isNotNull())
    # A row that fails where a label is missing, and that is none otherwise.
    check = found.select(missing.alias("m")).filter(F.when(F.size("m") > 0, F.raise_error(F.concat(F.lit("no such label: "), F.array_join("m", ", "))).cast("boolean")).otherwise(F.lit(False)))
    return kept.unionByName(check.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in cells.schema]))


def lower_triangle(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells whose row comes after their column, with both places; labels: locality, ord."""
    rows = labels.select(F.col("locality").alias("row_loc"), F.col("ord").alias("row_ord"))
    columns = labels.select(F.col("locality").alias("col_loc"), F.col("ord").alias("col_ord"))
    return cells.join(rows, "row_loc").join(columns, "col_loc").filter("row_ord > col_ord")


def full(low: DataFrame, labels: DataFrame, keys: Sequence[str] = (), value: str = "dist") -> DataFrame:
    """The symmetric matrix with zeros on its diagonal from the lower triangle."""
    keys = list(keys)
    both = F.explode(F.array(F.struct(F.col("row_loc").alias("r"), F.col("col_loc").alias("c")), F.struct(F.col("col_loc").alias("r"), F.col("row_loc").alias("c"))))
    sides = low.withColumn("o", both).select(*keys, F.col("o.r").alias("row_loc"), F.col("o.c").alias("col_loc"), value)
    own = labels.select(F.col("locality").alias("row_loc"), F.col("locality").alias("col_loc"), F.lit(0.0).alias(value))
    if keys:
        own = low.select(*keys).distinct().crossJoin(own).select(*keys, "row_loc", "col_loc", value)
    return sides.unionByName(own)


def missing_is_error(cells: DataFrame, column: str = "dist") -> DataFrame:
    """The cells; reading a null one fails."""
    return cells.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.lit("a distance is missing")).cast("double")).otherwise(F.col(column)))
