"""Quadrature of column functions over each row's interval, and of sampled series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import small
from lattica.plans.tables import keep

Function = Callable[[Column], Column]


def trapezoid(f: Function, a: Column, b: Column) -> Column:
    return (b - a) / 2 * (f(a) + f(b))


def kepler(f: Function, a: Column, b: Column) -> Column:
    return (b - a) / 6 * (f(a) + 4 * f((a + b) / 2) + f(b))


def _weighed(f: Function, a: Column, b: Column, n: int, weight: Callable[[Column], Column]) -> Column:
    h = (b - a) / n
    return F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.lit(0.0), lambda s, k: s + weight(k) * f(a + h * k))


def composite_trapezoid(f: Function, a: Column, b: Column, n: int) -> Column:
    if n < 1:
        raise ValueError("at least one panel is needed")
    return (b - a) / (2 * n) * _weighed(f, a, b, n, lambda k: F.when((k == 0) | (k == n), 1.0).otherwise(2.0))


def simpson(f: Function, a: Column, b: Column, n: int) -> Column:
    if n < 2 or n % 2:
        raise ValueError("an even number of panels is needed")
    return (b - a) / (3 * n) * _weighed(f, a, b, n, lambda k: F.when((k == 0) | (k == n), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0))


def composite_trapezoid_rows(intervals: DataFrame, f: Function, keys: list[str], a: str, b: str, n: int) -> DataFrame:
    """The composite rule for very many panels: a row a node, and one partial aggregation."""
    nodes = intervals.select(*keys, a, b, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("_k"))
    h = (F.col(b) - F.col(a)) / n
    term = F.when((F.col("_k") == 0) | (F.col("_k") == n), 0.5).otherwise(1.0) * h * f(F.col(a) + h * F.col("_k"))
    return nodes.groupBy(*keys).agg(F.sum(term).alias("integral"))


def sampled(series: DataFrame, group: list[str], x: Column, y: Column) -> DataFrame:
    """(group, integral) of the trapezoids between consecutive samples; 0 for a single one."""
    w = Window.partitionBy(*group).orderBy("_x")
    rows = series.select(*group, x.alias("_x"), y.alias("_y"))
    area = (F.lead("_x").over(w) - F.col("_x")) * (F.col("_y") + F.lead("_y").over(w)) / 2
    return rows.withColumn("_area", area).groupBy(*group).agg(F.coalesce(F.sum("_area"), F.lit(0.0)).alias("integral"))


def adaptive_trapezoid(intervals: DataFrame, f: Function, keys: list[str], a: str, b: str, err: float, panels: int = 15, deepest: int = 24) -> DataFrame:
    """(keys, integral, panels, status): panels are halved until the finer rule agrees.

    All open panels of all integrals are refined at once; those that agree within
    ``err / 2**(depth + 1)`` are summed, the others are split.  At the depth cap the finer value is
    taken and the status is MaxIterations.
    """
    h = (F.col(b) - F.col(a)) / panels
    k = F.explode(F.sequence(F.lit(0), F.lit(panels - 1)))
    todo = intervals.select(*keys, F.col(a).alias("_a"), h.alias("_h"), k.alias("_k")).select(*keys, (F.col("_a") + F.col("_h") * F.col("_k")).alias("_l"), (F.col("_a") + F.col("_h") * (F.col("_k") + 1)).alias("_r"))
    done = None
    for depth in range(deepest + 1):
        middle, width = (F.col("_l") + F.col("_r")) / 2, F.col("_r") - F.col("_l")
        low, mid, high = f(F.col("_l")), f(middle), f(F.col("_r"))
        judged = keep(todo.select(*keys, "_l", middle.alias("_m"), "_r", ((low + 2 * mid + high) * width / 4).alias("_fine"), ((low + high) * width / 2).alias("_coarse")))
        fits = F.abs(F.col("_fine") - F.col("_coarse")) <= err / 2 ** (depth + 1)
        taken = judged.where(fits | F.lit(depth == deepest)).groupBy(*keys).agg(F.sum("_fine").alias("_sum"), F.count("*").alias("_n"), F.bool_and(fits).alias("_ok"))
        done = taken if done is None else done.union(taken)
        left = judged.where(~fits)
        if depth == deepest or left.isEmpty():
            break
        todo = left.select(*keys, F.col("_l"), F.col("_m").alias("_r")).union(left.select(*keys, F.col("_m").alias("_l"), F.col("_r")))
    return done.groupBy(*keys).agg(F.sum("_sum").alias("integral"), F.sum("_n").alias("panels"), F.when(F.bool_and("_ok"), "Converged").otherwise("MaxIterations").alias("status"))


def romberg_outcome(f: Function, a: Column, b: Column, err: float = 1e-10, levels: int = 14, window: int = 8) -> Column:
    """struct(status, result, iterations): trapezoids of 1, 2, 4, ... panels, extrapolated in h**2 to 0.

    A level adds only its new nodes, and extrapolates over at most ``window`` levels.  It ends when two
    levels differ by at most ``err``, or after ``levels`` halvings; ``iterations`` counts these.
    """

    def refine(s: Column, k: Column) -> Column:
        panels = F.pow(F.lit(2.0), k - 1).cast("int")
        h = (b - a) / panels
        new = F.aggregate(F.sequence(F.lit(0), panels - 1), F.lit(0.0), lambda t, j: t + f(a + h * (j + 0.5)))

        def extrapolate(trapezoid: Column) -> Column:
            def join(t: Column, before: Column) -> Column:
                power = 4 * t["power"]
                return F.struct((t["v"] + (t["v"] - before) / (power - 1)).alias("v"), power.alias("power"), F.concat(t["row"], F.array(t["v"] + (t["v"] - before) / (power - 1))).alias("row"))

            start = F.struct(trapezoid.alias("v"), F.lit(1.0).alias("power"), F.array(trapezoid).alias("row"))
            found = F.aggregate(F.slice(s["row"], 1, window - 1), start, join)
            return small.let(found, lambda t: F.struct(t["row"].alias("row"), trapezoid.alias("sum"), t["v"].alias("x"), F.abs(t["v"] - s["x"]).alias("gap"), k.alias("k")))

        return small.let(s["sum"] / 2 + h / 2 * new, extrapolate)

    def step(s: Column) -> Column:
        return small.let(s["k"] + 1, lambda k: refine(s, k))

    first = small.let(trapezoid(f, a, b), lambda t: F.struct(F.array(t).alias("row"), t.alias("sum"), t.alias("x"), F.lit(float("inf")).alias("gap"), F.lit(0).alias("k")))
    return small.iterate(first, abs(err), levels, step)


def romberg(f: Function, a: Column, b: Column, err: float = 1e-10, levels: int = 14) -> Column:
    return romberg_outcome(f, a, b, err, levels)["result"]
