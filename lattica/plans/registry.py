"""All queries on the reference's operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.plans import q_linear, q_numeric, q_tables

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: f for part in (q_tables, q_linear, q_numeric) for name, (f, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in (q_tables, q_linear, q_numeric) for name, (_, sql) in part.QUERIES.items() if sql}
