"""An ordered map as a table of writes (key, value, seq): the last write of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build(writes: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """(key, value): the state after all writes."""
    return writes.groupBy(key).agg(F.max_by(value, seq).alias(value))


def build_set(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key).dropDuplicates([key])


def insert_returns(writes: DataFrame, key: str, value: str, seq: str, old: str = "old_value") -> DataFrame:
    """Each write with the value that it replaces, null at a key's first write."""
    return writes.withColumn(old, F.lag(value).over(Window.partitionBy(key).orderBy(seq)))


def size(state: DataFrame) -> DataFrame:
    return state.agg(F.count("*").alias("n"))


def is_empty(state: DataFrame) -> DataFrame:
    return state.agg((F.count("*") == 0).alias("empty"))


def contains(keys: DataFrame, state: DataFrame, key: str, flag: str = "found") -> DataFrame:
    """Each of the asked keys with whether the map has it."""
    has = build_set(state, key).withColumn("_has", F.lit(True))
    return keys.join(has, key, "left").withColumn(flag, F.coalesce("_has", F.lit(False))).drop("_has")


def get(keys: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Each of the asked keys with its value, null if there is none."""
    return keys.join(state, key, "left")


def get_strict(keys: DataFrame, state: DataFrame, key: str, value: str) -> DataFrame:
    """The same, but a missing key is an error."""
    missing = F.raise_error(F.concat(F.lit("no such key: "), F.col(key).cast("string")))
    found = keys.join(state.withColumn("_has", F.lit(True)), key, "left")
    return found.withColumn(value, F.when(F.col("_has"), F.col(value)).otherwise(missing)).drop("_has")


def update(state: DataFrame, key: str, value: str, where: Column, new: Column) -> DataFrame:
    """The state with the value changed at the keys that ``where`` tells."""
    return state.withColumn(value, F.when(where, new).otherwise(F.col(value)))


def remove(state: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return state.join(keys, key, "left_anti")


def removed(state: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return state.join(keys, key, "left_semi")
