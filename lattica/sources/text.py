"""Plain text sinks and sources: a value, or two values and ", ", a line; no header, quoting or escapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.ordered import sort_rows


def write_values(df: DataFrame, path: str, order: str, value: str) -> None:
    """One value a line, in order; the files of a large table follow each other by name."""
    df.orderBy(order).select(F.col(value).cast("string").alias("value")).na.fill("").write.mode("overwrite").text(path)


def write_pairs(left: DataFrame, right: DataFrame, path: str, order: str, value: str) -> None:
    """Two columns zipped by their place in the order of each, as far as the shorter one goes."""
    numbered = [sort_rows(df.select(order, F.col(value).alias("_v")), order, "_v", ordinal="_at") for df in (left, right)]
    both = numbered[0].select("_at", F.col("_v").alias("_a")).join(numbered[1].select("_at", F.col("_v").alias("_b")), "_at")
    both.orderBy("_at").select(F.concat_ws(", ", F.col("_a").cast("string"), F.col("_b").cast("string")).alias("value")).write.mode("overwrite").text(path)


def read_values(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", ", ", 2)
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("first"), F.get(parts, F.lit(1)).alias("second"))
