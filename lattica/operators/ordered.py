"""Sorting and priority-queue operators: every order is total, by a key and a tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.tables import keep


def sort_rows(df: DataFrame, *keys: str | Column, ordinal: str = "ord") -> DataFrame:
    """``df`` with each row's place from 0 in ascending order of the keys; the rows themselves come back in any order.

    A range-partitioned sort; the place is the row's number in its partition plus the rows of all
    partitions before, so no task sees all rows.  Null keys come first and NaN last; rows that are
    equal in all keys keep an arbitrary order among them.
    """
    at = F.monotonically_increasing_id()
    ordered = keep(df.orderBy(*keys).select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")))
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    firsts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    placed = ordered.join(F.broadcast(firsts), "_part")
    return placed.select(*df.columns, (F.col("_first") + F.col("_row")).alias(ordinal))


def unsorted_pairs(df: DataFrame, value: str, order: str, group: list[str]) -> DataFrame:
    """Rows whose value is less than the one before, in ``order`` within the group: none if sorted."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("previous", F.lag(value).over(w)).where(F.col(value) < F.col("previous"))


def heap_pop(df: DataFrame, priority: str | Column, tiebreak: str, k: int, group: list[str] | None = None, ordinal: str = "ord") -> DataFrame:
    """The ``k`` rows of least priority in pop order; all if there are fewer.

    Without ``group`` it is a top-k: each task gives k rows.  With groups the rank is limited before
    the shuffle as well, so a large group sends k rows a task.
    """
    df = df.withColumn("_priority", priority if isinstance(priority, Column) else F.col(priority))
    w = Window.partitionBy(*(group or [])).orderBy("_priority", tiebreak)
    if not group:
        df = df.orderBy("_priority", tiebreak).limit(k)
    out = df.withColumn(ordinal, F.row_number().over(w).cast("long") - 1).where(F.col(ordinal) < k)
    return out.drop("_priority")


def heap_rest(df: DataFrame, priority: str, tiebreak: str, k: int) -> DataFrame:
    """What is left after ``k`` pops: the rows beyond the k-th one in order."""
    last = df.orderBy(priority, tiebreak).limit(k).agg(F.max(F.struct(priority, tiebreak)).alias("_last"))
    return df.join(F.broadcast(last)).where(F.col("_last").isNull() | (F.struct(priority, tiebreak) > F.col("_last"))).drop("_last")


def heap_peek(df: DataFrame, value: str, priority: str, tiebreak: str, group: list[str]) -> DataFrame:
    """The value of least priority of each group."""
    return df.groupBy(*group).agg(F.min_by(value, F.struct(priority, tiebreak)).alias(value))


def heap_insert(df: DataFrame, more: DataFrame) -> DataFrame:
    return df.unionByName(more)
