"""Polynomial interpolants kept as tables, which new nodes update without the old samples.

An interpolant is a struct in its group's row: the nodes' ``x`` and ``y`` in the order of their arrival, the barycentric weights ``w``, the
last row of the divided differences ``last`` and Newton's coefficients ``diag``.  A node more is n divisions for each of them, and so is a value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.small import let
from lattica.plans.tables import join_on

PARTS = ["x", "y", "w", "last", "diag"]
SCHEMA = ", ".join(f"{p} array<double>" for p in PARTS)


def empty() -> Column:
    """The interpolant without nodes."""
    return F.struct(*[F.array().cast("array<double>").alias(p) for p in PARTS])


def with_node(known: Column, x: Column, y: Column) -> Column:
    """The interpolant with one node more; an ``x`` that it has already is an error."""
    repeated = F.raise_error(F.lit("an interpolant has this x already")).cast("double")
    gaps = F.transform(known["x"], lambda k: F.when(x == k, repeated).otherwise(x - k))
    weight = F.aggregate(gaps, F.lit(1.0), lambda p, g: p * g)
    pairs = F.zip_with(known["last"], F.reverse(gaps), lambda f, g: F.struct(f.alias("f"), g.alias("g")))
    differences = F.aggregate(pairs, F.array(y), lambda row, p: F.array_append(row, (F.element_at(row, -1) - p["f"]) / p["g"]))
    return let(
        F.struct(differences.alias("last"), (1.0 / weight).alias("w")),
        lambda new: F.struct(
            F.array_append(known["x"], x).alias("x"),
            F.array_append(known["y"], y).alias("y"),
            F.array_append(F.zip_with(known["w"], gaps, lambda w, g: -w / g), new["w"]).alias("w"),
            new["last"].alias("last"),
            F.array_append(known["diag"], F.element_at(new["last"], -1)).alias("diag"),
        ),
    )


def with_nodes(known: Column, new: Column) -> Column:
    """The interpolant with an array of struct(x, y) more."""
    return F.aggregate(new, known, lambda s, p: with_node(s, p["x"], p["y"]))


def _arrivals(series: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    node = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return series.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group).agg(F.array_sort(F.collect_list(node)).alias("_new"))


def build(series: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, interpolant) of the samples; those without a place or a value are no nodes, and a group without any has no row."""
    return _arrivals(series, group, x, y).select(*group, with_nodes(empty(), F.col("_new")).alias("interpolant"))


def extend(stored: DataFrame, series: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """The stored table with new samples taken in; new groups are added, others stay as they are.  Null groups are groups."""
    named = _arrivals(series, group, x, y).withColumnsRenamed({g: f"_new_{g}" for g in group})
    same = reduce(lambda s, g: s & F.col(g).eqNullSafe(F.col(f"_new_{g}")), group, F.lit(True))
    both = stored.withColumn("_old", F.lit(True)).join(named, same, "full")
    keys = [F.when(F.col("_old"), F.col(g)).otherwise(F.col(f"_new_{g}")).alias(g) for g in group]
    known = F.coalesce("interpolant", empty())
    return both.select(*keys, F.when(F.col("_new").isNull(), known).otherwise(with_nodes(known, F.col("_new"))).alias("interpolant"))


def barycentric_value(known: Column, x: Column) -> Column:
    """The value by the stored weights; exactly the node's y at a node, null without nodes."""
    node = lambda k: F.get(known["x"], k)
    places = F.sequence(F.lit(0), F.size(known["x"]) - 1)
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(None).cast("double").alias("exact"))

    def add(s: Column, k: Column) -> Column:
        share = F.try_divide(F.get(known["w"], k), x - node(k))
        y = F.get(known["y"], k)
        return F.struct((s["up"] + share * y).alias("up"), (s["down"] + share).alias("down"), F.when(x == node(k), y).otherwise(s["exact"]).alias("exact"))

    total = F.aggregate(places, start, add)
    return F.when(F.size(known["x"]) > 0, let(total, lambda t: F.coalesce(t["exact"], F.try_divide(t["up"], t["down"]))))


def newton_value(known: Column, x: Column) -> Column:
    """The value by the stored coefficients, from the last one inwards; null without nodes."""
    pairs = F.reverse(F.zip_with(known["diag"], known["x"], lambda c, k: F.struct(c.alias("c"), k.alias("x"))))
    return F.when(F.size(known["x"]) > 0, F.aggregate(pairs, F.lit(0.0), lambda s, p: s * (x - p["x"]) + p["c"]))


VALUES = {"barycentric": barycentric_value, "newton": newton_value}


def evaluate(stored: DataFrame, queries: DataFrame, group: list[str], x: str, method: str = "barycentric") -> DataFrame:
    """Each query of a group that has an interpolant, with ``y``."""
    return join_on(queries, stored, group).withColumn("y", VALUES[method](F.col("interpolant"), F.col(x).cast("double"))).drop("interpolant")
