"""Tridiagonal systems of any length, many at once, without a task that sees a whole system.

The rows a x[i-1] + d x[i] + c x[i+1] = r of a system are cut into chunks of CHUNK.  Two folds over a chunk eliminate its inner unknowns, so its first and last
unknown are left, and these again make a tridiagonal system, CHUNK / 2 times shorter; it is solved the same way, until each system is
one chunk.  A third fold brings the inner unknowns back.  There is no pivoting: for systems that are dominated by their diagonal, as those of splines.
All of it is expressions on arrays of bounded size, with one aggregation and one join a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.small import let
from lattica.plans.tables import Kept, join_on

#: Rows of a chunk.
CHUNK = 128


def _equation(a: Column, d: Column, c: Column, r: Column) -> Column:
    return F.struct(a.alias("a"), d.alias("d"), c.alias("c"), r.alias("r"))


def _down(rows: Column) -> Column:
    """Rows 1 ... of a chunk, each with x[0] in the place of x[i-1]."""

    def step(done: Column, e: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1)), _equation(F.lit(-1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)))
        of = lambda s: let(e["a"] / s["d"], lambda w: _equation(-w * s["a"], e["d"] - w * s["c"], e["c"], e["r"] - w * s["r"]))
        return F.concat(done, F.array(let(before, of)))

    none = F.array().cast("array<struct<a: double, d: double, c: double, r: double>>")
    return F.aggregate(F.slice(rows, F.lit(2), F.size(rows) - 1), none, step)


def _up(rows: Column) -> Column:
    """Row 0 of a chunk, with its last unknown in the place of x[1]."""
    start = _equation(F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0))
    step = lambda s, e: let(e["c"] / s["d"], lambda w: _equation(e["a"], e["d"] - w * s["a"], -w * s["c"], e["r"] - w * s["r"]))
    return F.aggregate(F.reverse(F.slice(rows, F.lit(1), F.size(rows) - 1)), start, step)


def _inner(down: Column, first: Column, last: Column) -> Column:
    """All unknowns of a chunk of two or more from its first and last."""
    rows = F.reverse(F.slice(down, F.lit(1), F.greatest(F.size(down) - 1, F.lit(0))))
    step = lambda x, e: F.concat(F.array((e["r"] - e["a"] * first - e["c"] * x[0]) / e["d"]), x)
    return F.concat(F.array(first), F.aggregate(rows, F.array(last), step))


def solve_chunks(chunks: DataFrame, group: list[str]) -> DataFrame:
    """(all columns of ``chunks``, x, following): ``chunks`` has (group, q, rows), where ``rows`` are structs with a, d, c and r in order, and a system's chunks have consecutive q.

    ``x`` are the unknowns of the chunk's rows and ``following`` the one after them, null at the system's end.
    """
    rows, single = F.col("rows"), F.size("rows") == 1
    own = lambda k: _equation(*[rows[k][c] for c in "adcr"])
    chunks = chunks.where(F.size("rows") > 0)
    chunks = chunks.withColumns({"_down": _down(rows), "_first": F.when(single, own(0)).otherwise(_up(rows))}).withColumn("_last", F.try_element_at("_down", F.lit(-1)))
    chunks = Kept(chunks, "chunks").df
    alone = chunks.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1").limit(1).isEmpty()
    if alone:
        f, l = F.col("_first"), F.col("_last")
        det = f["d"] * l["d"] - f["c"] * l["a"]
        first, last = (f["r"] * l["d"] - f["c"] * l["r"]) / det, (f["d"] * l["r"] - l["a"] * f["r"]) / det
        x = F.when(single, F.array(f["r"] / f["d"])).otherwise(_inner(F.col("_down"), first, last))
        return chunks.withColumns({"x": x, "following": F.lit(None).cast("double")}).drop("_down", "_first", "_last")
    place = lambda k, e: F.struct((2 * F.col("q") + k).alias("i"), e.alias("e"))
    ends = chunks.select(*group, F.explode(F.filter(F.array(place(0, F.col("_first")), place(1, F.col("_last"))), lambda p: p["e"].isNotNull())).alias("p"))
    shorter = ends.select(*group, F.floor(F.col("p.i") / CHUNK).alias("q"), F.struct("p.i", "p.e.a", "p.e.d", "p.e.c", "p.e.r").alias("row"))
    solved = solve_chunks(shorter.groupBy(*group, "q").agg(F.array_sort(F.collect_list("row")).alias("rows")), group)
    each = solved.select(*group, F.explode(F.arrays_zip(F.col("rows.i").alias("i"), "x")).alias("p")).select(*group, "p.i", "p.x")
    # A chunk's first unknown is also the one that follows the chunk before.
    q = F.floor(F.col("i") / 2)
    to = F.when(F.col("i") % 2 == 1, F.array(F.struct(q.alias("q"), F.lit(1).alias("k")))).otherwise(F.array(F.struct(q.alias("q"), F.lit(0).alias("k")), F.struct((q - 1).alias("q"), F.lit(2).alias("k"))))
    sent = each.select(*group, "x", F.explode(to).alias("to"))
    known = sent.groupBy(*group, F.col("to.q").alias("q")).agg(*[F.max(F.when(F.col("to.k") == k, F.col("x"))).alias(name) for k, name in enumerate(("_x0", "_x1", "following"))])
    back = join_on(chunks, known, [*group, "q"])
    x = F.when(single, F.array("_x0")).otherwise(_inner(F.col("_down"), F.col("_x0"), F.col("_x1")))
    return back.withColumn("x", x).drop("_down", "_first", "_last", "_x0", "_x1")


def tridiagonal(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, i, x) of the systems with rows (group, i, a, d, c, r), i without gaps; the first row's a and the last row's c don't count.

    Groups may be null.  A zero that elimination meets on the diagonal is an error; see above for which systems have none.
    """
    row = F.struct("i", *[F.col(c).cast("double").alias(c) for c in "adcr"])
    chunks = rows.groupBy(*group, F.floor(F.col("i") / CHUNK).alias("q")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    found = solve_chunks(chunks, group)
    return found.select(*group, F.explode(F.arrays_zip(F.col("rows.i").alias("i"), "x")).alias("p")).select(*group, "p.i", "p.x")
