"""All queries of the library over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import matrix_queries, relational_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**matrix_queries.QUERIES, **relational_queries.QUERIES}
ORACLE: dict[str, str] = {**matrix_queries.ORACLE, **relational_queries.ORACLE}
