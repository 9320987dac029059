"""Lookups in small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_or_keep(df: DataFrame, dim: DataFrame, column: str, key: str, value: str, out: str) -> DataFrame:
    """df with the dimension's value for a column, or the column itself where there is none."""
    d = dim.select(F.col(key).alias(column), F.col(value).alias("__v"))
    return df.join(d, column, "left").withColumn(out, F.coalesce("__v", column)).drop("__v")


def lookup_strict(df: DataFrame, dim: DataFrame, column: str, key: str, value: str, out: str) -> DataFrame:
    """df with the dimension's value for a column; a missing one is an error."""
    d = dim.select(F.col(key).alias(column), F.col(value).alias("__v"))
    missing = F.raise_error(F.concat(F.lit("no entry for "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    return df.join(d, column, "left").withColumn(out, F.when(F.col("__v").isNotNull(), F.col("__v")).otherwise(missing)).drop("__v")


def replaced(df: DataFrame, column: str, values: dict[str, str]) -> DataFrame:
    """df with some values of a column replaced."""
    return df.replace(values, subset=[column])
