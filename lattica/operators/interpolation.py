"""Interpolation of sampled series: a series' nodes are an array of struct(x, y) in its row.

Polynomials of a few nodes are folds in the row of each query; long series are splines, whose
segments are found by a range condition on the query.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import banded
from lattica.operators.ordered import sort_rows
from lattica.plans.tables import Kept, join_on


def uniform_nodes(a: Column, b: Column, n: int) -> Column:
    """array of n + 1 places."""
    if n < 1:
        raise ValueError("two nodes are needed at least")
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: a + (b - a) * k / n)


def chebyshev_nodes(a: Column, b: Column, n: int) -> Column:
    """array of n + 1 places, ascending."""
    return F.transform(F.sequence(F.lit(n), F.lit(0), F.lit(-1)), lambda k: (a + b) / 2 + (b - a) / 2 * F.cos((2 * k + 1) * (math.pi / (2 * n + 2))))


def nodes(series: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, nodes): each series as an array sorted by x; a repeated x is an error."""
    found = series.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("nodes"))
    single = F.size(F.array_distinct(F.transform("nodes", lambda p: p["x"]))) == F.size("nodes")
    return found.withColumn("nodes", F.when(single, F.col("nodes")).otherwise(F.raise_error(F.lit("a series repeats an x"))))


def append(known: Column, x: Column, y: Column) -> Column:
    """The nodes with one more; the interpolant is the one that is built from all of them."""
    return F.array_sort(F.concat(known, F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))))


def from_function(f: Callable[[Column], Column], places: Column) -> Column:
    """The nodes of a function at these places."""
    return F.transform(places, lambda x: F.struct(x.cast("double").alias("x"), f(x).cast("double").alias("y")))


def _product(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda s, v: s * of(v))


def barycentric(known: Column, x: Column) -> Column:
    """The barycentric form; exactly the node's y at a node."""
    at_node = F.filter(known, lambda p: p["x"] == x)

    def sums(s: Column, p: Column) -> Column:
        others = F.filter(known, lambda o: o["x"] != p["x"])
        weight = F.try_divide(F.lit(1.0), (x - p["x"]) * _product(others, lambda o: p["x"] - o["x"]))
        return F.struct((s["up"] + weight * p["y"]).alias("up"), (s["down"] + weight).alias("down"))

    total = F.aggregate(known, F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down")), sums)
    return F.when(F.size(at_node) > 0, F.get(at_node, F.lit(0))["y"]).otherwise(F.try_divide(total["up"], total["down"]))


def aitken_neville(known: Column, x: Column) -> Column:
    """Neville's scheme: each round joins neighbours to polynomials of one degree more."""
    start = F.transform(known, lambda p: F.struct(p["x"].alias("lo"), p["x"].alias("hi"), p["y"].alias("v")))

    def join(left: Column, right: Column) -> Column:
        value = ((x - left["lo"]) * right["v"] - (x - right["hi"]) * left["v"]) / (right["hi"] - left["lo"])
        return F.struct(left["lo"].alias("lo"), right["hi"].alias("hi"), value.alias("v"))

    def rounds(row: Column, _: Column) -> Column:
        n = F.size(row) - 1
        return F.when(n >= 1, F.zip_with(F.slice(row, 1, F.greatest(n, F.lit(0))), F.slice(row, 2, F.greatest(n, F.lit(0))), join)).otherwise(row)

    return F.get(F.aggregate(known, start, rounds), F.lit(0))["v"]


def newton_polynomial(known: Column, x: Column) -> Column:
    """Divided differences: the first of each column is a coefficient, taken in as the columns shrink."""
    first = F.get(known, F.lit(0))
    start = F.struct(
        F.transform(known, lambda p: F.struct(p["x"].alias("lo"), p["x"].alias("hi"), p["y"].alias("v"))).alias("row"),
        first["y"].alias("sum"),
        F.lit(1.0).alias("basis"),
    )

    def rounds(s: Column, p: Column) -> Column:
        n = F.size(s["row"]) - 1
        rest = F.greatest(n, F.lit(0))
        row = F.zip_with(F.slice(s["row"], 1, rest), F.slice(s["row"], 2, rest), lambda a, b: F.struct(a["lo"].alias("lo"), b["hi"].alias("hi"), ((b["v"] - a["v"]) / (b["hi"] - a["lo"])).alias("v")))
        basis = s["basis"] * (x - p["x"])
        new = F.struct(row.alias("row"), (s["sum"] + F.coalesce(F.get(row, F.lit(0))["v"], F.lit(0.0)) * basis).alias("sum"), basis.alias("basis"))
        return F.when(n >= 1, new).otherwise(s)

    return F.aggregate(known, start, rounds)["sum"]


METHODS: dict[str, Callable[[Column, Column], Column]] = {"barycentric": barycentric, "neville": aitken_neville, "newton": newton_polynomial}


def interpolate(series: DataFrame, queries: DataFrame, group: list[str], x: str, method: str = "barycentric") -> DataFrame:
    """Each query with ``y``; ``series`` is what ``nodes`` gives."""
    return queries.join(series, group).withColumn("y", METHODS[method](F.col("nodes"), F.col(x))).drop("nodes")


def spline_segments(series: DataFrame, group: list[str], x: str, y: str, left: float | str = 0.0, right: float | str = 0.0) -> DataFrame:
    """(group, lo, hi, y_lo, y_hi, m_lo, m_hi, first, last): the clamped cubic spline's pieces.

    ``left`` and ``right`` are the slopes at the ends, numbers or columns (of the end's own knot).  Knots are numbered by a range-partitioned sort and cut into chunks,
    each with the knots right before and after it, and the moments' tridiagonal system is solved chunk by chunk, so a long series is many
    tasks' work.  A series with one knot, or with two at one place, is an error.
    """
    slope = lambda v: F.col(v) if isinstance(v, str) else F.lit(float(v))
    knots = series.select(*group, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), slope(left).cast("double").alias("_left"), slope(right).cast("double").alias("_right"))
    placed = sort_rows(knots, *group, "_x", ordinal="_i")
    chunk = lambda k: F.floor((F.col("_i") + k) / banded.CHUNK)
    knot = F.struct(F.col("_i").alias("i"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_left").alias("left"), F.col("_right").alias("right"))
    sent = placed.select(*group, F.explode(F.array_distinct(F.array(*[chunk(k) for k in (-2, -1, 0, 1)]))).alias("q"), knot.alias("k"))
    near = sent.groupBy(*group, "q").agg(F.array_sort(F.collect_list("k")).alias("k"))
    mine = lambda k: F.floor(k["i"] / banded.CHUNK) == F.col("q")

    def row(k: Column, at: Column) -> Column:
        before, after = F.when(at > 0, F.get("k", at - 1)), F.get("k", at + 1)
        g, h = k["x"] - before["x"], after["x"] - k["x"]
        wrong = F.raise_error(F.lit("a spline needs two knots at different places at least")).cast("double")
        fine = F.when((g <= 0) | (h <= 0) | (g.isNull() & h.isNull()), wrong)
        g0, h0 = F.coalesce(g, F.lit(0.0)), F.coalesce(h, F.lit(0.0))
        bend = F.coalesce((after["y"] - k["y"]) / h, k["right"]) - F.coalesce((k["y"] - before["y"]) / g, k["left"])
        parts = {"x": k["x"], "y": k["y"], "a": g0, "d": F.coalesce(fine, 2 * (g0 + h0)), "c": h0, "r": 6 * bend}
        return F.struct(F.when(mine(k), F.struct(*[v.alias(n) for n, v in parts.items()])).alias("own"), k.alias("k"), before.isNull().alias("first"), after.isNull().alias("last"))

    told = near.select(*group, "q", F.transform("k", row).alias("t"))
    rows = F.transform(F.filter("t", lambda t: t["own"].isNotNull()), lambda t: t["own"])
    ends = F.transform(F.filter("t", lambda t: t["own"].isNotNull()), lambda t: F.struct(t["first"].alias("first"), t["last"].alias("last")))
    beyond = F.get(F.filter("t", lambda t: F.floor(t["k"]["i"] / banded.CHUNK) > F.col("q")), F.lit(0))
    chunks = told.select(*group, "q", rows.alias("rows"), ends.alias("ends"), F.struct(beyond["k"]["x"].alias("x"), beyond["k"]["y"].alias("y"), beyond["last"].alias("last")).alias("beyond"))
    solved = banded.solve_chunks(chunks, group)

    def piece(r: Column, at: Column) -> Column:
        inside = at + 1 < F.size("rows")
        hi = lambda c: F.when(inside, F.get("rows", at + 1)[c]).otherwise(F.col("beyond")[c])
        last = F.when(inside, F.get("ends", at + 1)["last"]).otherwise(F.col("beyond")["last"])
        ahead = F.when(inside, F.get("x", at + 1)).otherwise(F.col("following"))
        parts = {"lo": r["x"], "hi": hi("x"), "y_lo": r["y"], "y_hi": hi("y"), "m_lo": F.get("x", at), "m_hi": ahead, "first": F.get("ends", at)["first"], "last": last}
        return F.struct(*[v.alias(n) for n, v in parts.items()])

    pieces = solved.select(*group, F.explode(F.transform("rows", piece)).alias("s"))
    return pieces.where("s.hi IS NOT NULL").select(*group, "s.*")


def spline_value(x: Column) -> Column:
    """The value at ``x`` on a piece of ``spline_segments``."""
    h = F.col("hi") - F.col("lo")
    t = (x - F.col("lo")) / h
    bend = F.col("m_lo") * (-t / 3 + t * t / 2 - t * t * t / 6) + F.col("m_hi") * (-t / 6 + t * t * t / 6)
    return F.col("y_lo") * (1 - t) + F.col("y_hi") * t + h * h * bend


def as_of(points: DataFrame, queries: DataFrame, group: list[str], at: str, x: str, name: str, strict: bool = False, forward: bool = False) -> DataFrame:
    """Each query with ``name``, a struct of the last point of its group with ``at`` up to ``x``; null if there is none.

    ``strict`` leaves out points right at ``x``; ``forward`` takes the first point from ``x`` on
    instead.  Of points at one place the greatest counts, by their columns in order.  Groups may be null, which is a group as any other.

    Points and queries are made once and partitioned by ranges of group and place, which Spark takes from their quantiles, so neither a long series nor a dense
    stretch of it is one task's work; each range is told the last point of the ranges before.
    """
    sign = -1.0 if forward else 1.0
    whole = F.struct(*[F.col(c) for c in points.columns])
    asked = F.struct(*queries.columns)
    left = points.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], (sign * F.col(at).cast("double")).alias("_x"), F.lit(1).alias("_kind"), whole.alias("_p"))
    right = queries.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], (sign * F.col(x).cast("double")).alias("_x"), F.lit(0 if strict else 2).alias("_kind"), asked.alias("_q"))
    keys = [f"_g{k}" for k in range(len(group))]
    both = left.unionByName(right, allowMissingColumns=True)
    both = Kept(both.repartitionByRange(*keys, "_x", "_kind").withColumn("_range", F.spark_partition_id()), "stream").df
    order = [*keys, "_x", "_kind", "_p"]
    lasts = both.where("_p IS NOT NULL").groupBy("_range").agg(F.max(F.struct(*order)).alias("_last"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = both.select("_range").distinct().join(lasts, "_range", "left")
    carried = ranges.select("_range", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    so_far = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("_p").isNotNull(), F.struct(*keys, "_p"))
    found = both.withColumn("_own", F.last(known, ignorenulls=True).over(so_far)).where("_q IS NOT NULL")
    found = found.join(carried, "_range").withColumn("_found", F.coalesce("_own", F.when(F.col("_carried").isNotNull(), F.struct(*[f"_carried.{c}" for c in (*keys, "_p")]))))
    same = reduce(lambda s, k: s & F.col(k).eqNullSafe(F.col(f"_found.{k}")), keys, F.lit(True))
    return found.select("_q.*", F.when(same, F.col("_found._p")).alias(name))


def spline(segments: DataFrame, queries: DataFrame, group: list[str], x: str) -> DataFrame:
    """Each query with ``y``: left of the first knot the first piece goes on; right of the last is an error."""
    firsts = segments.where("first").select(*group, F.struct(*segments.columns).alias("_first"))
    placed = join_on(as_of(segments, queries, group, "lo", x, "_piece", strict=True), firsts, group)
    found = placed.select(F.struct(*queries.columns).alias("_q"), F.coalesce("_piece", "_first").alias("_s")).select("_q", *[F.col(f"_s.{c}").alias(c) for c in segments.columns if c not in group])
    q = F.col("_q")[x]
    beyond = F.raise_error(F.lit("a query lies right of the last knot"))
    return found.select("_q.*", F.when(F.col("last") & (q > F.col("hi")), beyond.cast("double")).otherwise(spline_value(q)).alias("y"))


def nearest(points: DataFrame, queries: DataFrame, group: list[str], at: str, x: str, name: str = "nearest") -> DataFrame:
    """Each query with a struct of its group's point next to ``x``; of two at the same distance the lesser one."""
    before = as_of(points, queries, group, at, x, "_before")
    both = as_of(points, before, group, at, x, "_after", forward=True)
    gap = lambda side: F.abs(F.col(x) - F.col(side)[at])
    chosen = F.when(F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")).otherwise(F.col("_after"))
    return both.select(*queries.columns, chosen.alias(name))


def segments_of_samples(series: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, lo, hi, y_lo, y_hi): consecutive samples."""
    w = Window.partitionBy(*group).orderBy(x)
    pairs = series.select(*group, F.col(x).alias("lo"), F.lead(x).over(w).alias("hi"), F.col(y).alias("y_lo"), F.lead(y).over(w).alias("y_hi"))
    return pairs.where("hi IS NOT NULL")


def second_differences(series: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, x, difference): the second divided difference of each inner sample and its neighbours."""
    w = Window.partitionBy(*group).orderBy(x)
    before, after = F.lag(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).over(w), F.lead(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).over(w)
    rows = series.select(*group, x, F.col(y).alias("_y"), before.alias("_b"), after.alias("_a")).where("_a IS NOT NULL AND _b IS NOT NULL")
    right = (F.col("_a.y") - F.col("_y")) / (F.col("_a.x") - F.col(x))
    left = (F.col("_y") - F.col("_b.y")) / (F.col(x) - F.col("_b.x"))
    return rows.select(*group, x, ((right - left) / (F.col("_a.x") - F.col("_b.x"))).alias("difference"))
