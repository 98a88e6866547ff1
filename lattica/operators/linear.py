"""Linear algebra on tables: coordinate matrices (sys, i, j, a), iterations by join and aggregation, least squares.

``sys`` names the system, so many systems iterate together, each of any size and sparsity.  A step
is one equi-join on the column index and one aggregation by row, combined before the shuffle.  A
matrix is bucketed by (sys, j) once, so only vectors move (or are broadcast, if Spark finds them
small); a few steps make one plan, whose vector is written to the shared folder.  Systems that are
done leave the iteration.  Small dense systems are solved in their row by ``small``; relaxation and
colouring send sparse systems of at most WHOLE_CELLS cells to tasks that iterate them whole (``whole``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import whole
from lattica.plans.tables import Bucketed, Kept, keep

#: Steps in one plan; statuses are looked at, and iterations counted, in these strides.  A sweep of more than two colours is several steps.
STRIDE = 6
#: Cells and right-hand sides of a system that one task may hold.
WHOLE_CELLS = 1_000_000
#: The index of a coordinate that is always one, which carries the right-hand side.
_ONE = -1


def coordinates(systems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sys, a, b) with arrays to coordinate tables of the matrix and the right-hand side."""
    rows = systems.select("sys", F.posexplode("a").alias("i", "row"))
    a = rows.select("sys", F.col("i").cast("long").alias("i"), F.posexplode("row").alias("j", "a")).withColumn("j", F.col("j").cast("long"))
    return a, systems.select("sys", F.posexplode("b").alias("i", "v")).withColumn("i", F.col("i").cast("long"))


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """(sys, i, v): the product of (sys, i, j, a) and (sys, i, v)."""
    right = x.select("sys", F.col("i").alias("j"), "v")
    return a.join(right, ["sys", "j"]).groupBy("sys", "i").agg(F.sum(F.col("a") * F.col("v")).alias("v"))


def _out(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    return reduce(DataFrame.union, [p.select(*columns) for p in parts])


def _told(norm: Column, eps: float, last: bool) -> Column:
    """Status of a residual's norm; null while the system goes on."""
    return F.when(norm.isNull() | F.isnan(norm), "Failed").when(norm <= eps, "Converged").when(F.lit(last), "MaxIterations")


def _finished(rows: DataFrame, told: DataFrame, n: int) -> DataFrame:
    """(sys, i, v, status, iterations) of the systems that are done."""
    done = rows.join(told.where("status IS NOT NULL"), "sys")
    status = F.col("status")
    return done.select("sys", "i", F.when(status != "Failed", F.col("v")).alias("v"), "status", F.when(status == "Converged", F.lit(n)).alias("iterations"))


def colouring(a: DataFrame) -> DataFrame:
    """(sys, i, colour) of the unknowns of (sys, i, j, a), so that no equation holds two of one colour.

    Rounds of Jones and Plassmann: an unknown whose number's hash is above those of all its uncoloured neighbours takes the least colour that
    none of its coloured neighbours has.  The hash decides, so the colours don't depend on the partitioning; the rounds grow with the
    logarithm of the unknowns.  Systems of at most WHOLE_CELLS cells go through the rounds in a task; in greater ones a round is a join and
    an aggregation, and an unknown's neighbours are aggregated, never gathered (but for their distinct colours).
    """
    a = a.where("a != 0")
    large, few, count = _sizes(a.select("sys"))
    found = []
    if few:
        cells = _without(a, large).select("sys", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.xxhash64("sys", "i").alias("h"), F.xxhash64("sys", "j").alias("g"))
        found.append(keep(whole.dealt(cells, count, whole.coloured, f"sys {_kind(a)}, i long, colour int")))
    if large is not None or not few:
        found.append(_colouring_by_tables(a if large is None else a.join(large, "sys", "left_semi")))
    return _out(found, ["sys", "i", "colour"])


def _kind(a: DataFrame) -> str:
    return a.schema["sys"].dataType.simpleString()


def _sizes(rows: DataFrame) -> tuple[DataFrame | None, bool, int]:
    """(systems of more than WHOLE_CELLS of ``rows`` (sys), None without any; whether there are others; how many rows these have)."""
    sizes = Kept(rows.groupBy("sys").agg(F.count("*").alias("n")), "sizes")
    is_large = F.col("n") > WHOLE_CELLS
    most, others, count = sizes.df.agg(F.count(F.when(is_large, 1)), F.count(F.when(~is_large, 1)), F.sum(F.when(~is_large, F.col("n")))).first()
    large = keep(sizes.df.where(is_large).select("sys"), "large") if most else None
    sizes.drop()
    return large, others > 0, count or 0


def _without(rows: DataFrame, large: DataFrame | None) -> DataFrame:
    return rows if large is None else rows.join(large, "sys", "left_anti")


def _colouring_by_tables(a: DataFrame) -> DataFrame:
    entries = a.select("sys", "i", "j")
    edges = entries.where("i != j").union(entries.where("i != j").select("sys", F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    edges = Kept(edges, "graph")
    nodes = entries.select("sys", "i").union(entries.select("sys", "j")).distinct()
    now = Kept(nodes.select("sys", "i", F.lit(None).cast("int").alias("colour")))
    rank = lambda i: F.struct(F.xxhash64("sys", i).alias("h"), F.col(i).alias("i"))
    while not now.df.where("colour IS NULL").isEmpty():
        around = edges.df.join(now.df.withColumnsRenamed({"i": "j", "colour": "_other"}), ["sys", "j"])
        told = around.groupBy("sys", "i").agg(F.max(F.when(F.col("_other").isNull(), rank("j"))).alias("_rival"), F.collect_set("_other").alias("_taken"))
        both = now.df.join(told, ["sys", "i"], "left")
        taken = F.coalesce("_taken", F.array().cast("array<int>"))
        least = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(taken)), taken))
        wins = F.col("_rival").isNull() | (rank("i") > F.col("_rival"))
        then = Kept(both.select("sys", "i", F.coalesce("colour", F.when(wins, least)).alias("colour")))
        now.drop()
        now = then
    edges.drop()
    return now.df


def relax(a: DataFrame, b: DataFrame, eps: float, most: int, omega: float = 1.0, colours: int | DataFrame = 0, stride: int = STRIDE) -> DataFrame:
    """(sys, i, v, status, iterations) of Jacobi's method (without ``colours``) or successive over-relaxation, from the zero vector.

    A sweep of over-relaxation takes the unknowns by colour: i modulo ``colours``, or what a table (sys, i, colour) such as ``colouring``'s says.  No equation may
    hold two unknowns of a colour, so each colour is one parallel step that sees the new values of
    those before.  ``omega`` 1 is Gauss and Seidel's method.  It ends when the residual's norm is at most ``eps``; a
    zero on the diagonal fails.  Iterations are counted in strides.  Systems of at most WHOLE_CELLS cells and right-hand sides are iterated
    whole in a task, each matrix shuffled once; greater ones by a join and an aggregation a step.
    """
    if not 0 < omega < 2:
        raise ValueError("omega has to lie between 0 and 2")
    a, number = a.where("a != 0"), colours
    if isinstance(colours, DataFrame):
        number = (colours.agg(F.max("colour")).first()[0] or 0) + 1
    sweeps = max(1, 2 * stride // max(2, number))
    large, few, count = _sizes(a.select("sys").union(b.select("sys")))
    out = []
    if few:
        long = lambda c: F.col(c).cast("long").alias(c)
        row = lambda kind, i, j, v: ["sys", F.lit(kind).alias("kind"), i, j, v]
        none = F.lit(0).cast("long").alias("j")
        rows = _without(a, large).select(row(whole.CELL, long("i"), long("j"), F.col("a").cast("double").alias("a")))
        rows = rows.union(_without(b, large).select(row(whole.SIDE, long("i"), none, F.col("v").cast("double").alias("a"))))
        if isinstance(colours, DataFrame):
            rows = rows.union(_without(colours, large).select(row(whole.COLOUR, long("i"), F.col("colour").cast("long").alias("j"), F.lit(0.0).alias("a"))))
        run = whole.relaxed(eps, most, omega, None if isinstance(colours, DataFrame) else colours, number, sweeps)
        out.append(keep(whole.dealt(rows, count, run, f"sys {_kind(b)}, i long, v double, status string, iterations int")))
        if not out[0].where("status = 'Clash'").isEmpty():
            raise ValueError("an equation holds two unknowns of one colour")
    if large is not None or not few:
        mine = lambda rows: rows if large is None else rows.join(large, "sys", "left_semi")
        out.append(_relax_by_tables(mine(a), mine(b), eps, most, omega, mine(colours) if isinstance(colours, DataFrame) else colours, number, sweeps))
    return _out(out, ["sys", "i", "v", "status", "iterations"])


def _relax_by_tables(a: DataFrame, b: DataFrame, eps: float, most: int, omega: float, colours: int | DataFrame, number: int, sweeps: int) -> DataFrame:
    if isinstance(colours, DataFrame):
        two = [colours.select("sys", F.col("i").alias(k), F.col("colour").alias(f"_{k}")) for k in "ij"]
        clash = a.where("i != j").join(two[0], ["sys", "i"]).join(two[1], ["sys", "j"]).where("_i = _j")
        b = b.join(colours.select("sys", "i", "colour"), ["sys", "i"], "left").withColumn("colour", F.coalesce("colour", F.lit(0)))
    else:
        clash = a.where(f"i != j AND i % {colours} = j % {colours}") if colours else a.limit(0)
        b = b.withColumn("colour", F.col("i") % colours if colours else F.lit(0))
    if not clash.isEmpty():
        raise ValueError("an equation holds two unknowns of one colour")
    cells = a.count()
    b = Kept(b.join(a.where("i = j").select("sys", "i", F.col("a").alias("d")), ["sys", "i"], "left"))
    failed = Kept(b.df.groupBy("sys").agg(F.bool_or(F.col("d").isNull()).alias("zero")).where("zero"))
    out = [keep(b.df.join(failed.df, "sys", "left_semi").select("sys", "i", F.lit(None).cast("double").alias("v"), F.lit("Failed").alias("status"), F.lit(None).cast("int").alias("iterations")))]
    fine = Kept(b.df.join(failed.df, "sys", "left_anti"))
    ones = fine.df.select("sys", F.lit(_ONE).cast("long").alias("i"), F.lit(_ONE).cast("long").alias("j"), F.lit(1.0).alias("a")).distinct()
    size = fine.df.select("sys", "i", "d", "colour")
    steps = []
    for colour in range(max(1, number)):
        mine = F.col("colour") == colour
        turned = a.join(size.where(mine), ["sys", "i"]).select("sys", "i", "j", F.when(F.col("i") == F.col("j"), 1.0 - omega).otherwise(-omega * F.col("a") / F.col("d")).alias("a"))
        side = fine.df.where(mine).select("sys", "i", F.lit(_ONE).cast("long").alias("j"), (omega * F.col("v") / F.col("d")).alias("a"))
        rest = size.where(~mine).select("sys", "i", F.col("i").alias("j"), F.lit(1.0).alias("a"))
        steps.append(Bucketed(turned.union(side).union(rest).union(ones), ["sys", "j"], cells))
    gaps = Bucketed(a.join(size.select("sys", "i"), ["sys", "i"]).select("sys", "i", "j", "a").union(fine.df.select("sys", "i", F.lit(_ONE).cast("long").alias("j"), -F.col("v"))), ["sys", "j"], cells)
    x = Kept(fine.df.select("sys", "i", F.lit(0.0).alias("v")).union(ones.select("sys", "i", F.lit(1.0))))
    n = 0
    while True:
        norms = matvec(gaps.df, x.df).groupBy("sys").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
        told = Kept(norms.select("sys", _told(F.col("norm"), eps, n >= most).alias("status")))
        ended, systems = told.df.agg(F.count("status"), F.count("*")).first()
        if ended:  # written out, so a vector can go once the next one is there
            out.append(keep(_finished(x.df.where(f"i != {_ONE}"), told.df, n)))
        if ended == systems:
            break
        vector = x.df.join(told.df.where("status IS NULL"), "sys", "left_semi")
        here = min(sweeps, most - n)
        for _ in range(here):
            for step in steps:
                vector = matvec(step.df, vector)
        then = Kept(vector)
        x.drop()
        told.drop()
        x, n = then, n + here
    for table in (*steps, gaps, b, failed, fine, x, told):
        table.drop()
    return _out(out, ["sys", "i", "v", "status", "iterations"])


def jacobi(a: DataFrame, b: DataFrame, eps: float, most: int) -> DataFrame:
    return relax(a, b, eps, most)


def descend(a: DataFrame, b: DataFrame, eps: float, most: int, conjugate: bool) -> DataFrame:
    """(sys, i, v, status, iterations) of conjugate gradients, or of steepest descent, from the zero vector.

    For symmetric positive definite matrices; a direction without curvature fails.  It ends when the
    norm of the recursive residual is at most ``eps``.
    """
    matrix = Bucketed(a.where("a != 0"), ["sys", "j"], a.count())
    rows = Kept(b.select("sys", "i", F.lit(0.0).alias("v"), F.col("v").alias("r"), F.lit(0.0).alias("p"), F.lit(0.0).alias("old")))
    now, out, n = rows.df, [], 0
    while True:
        sizes = keep(now.groupBy("sys").agg(F.sum(F.col("r") * F.col("r")).alias("rr")))
        told = keep(sizes.select("sys", "rr", _told(F.sqrt("rr"), eps, n >= most).alias("status")))
        out.append(_finished(now, told.drop("rr"), n))
        going = told.where("status IS NULL").select("sys", "rr")
        if going.isEmpty():
            break
        turned = F.col("r") + F.coalesce(F.try_divide("rr", "old"), F.lit(0.0)) * F.col("p") if conjugate else F.col("r")
        ahead = now.join(going, "sys").select("sys", "i", "v", "r", turned.alias("p"), "rr")
        image = matvec(matrix.df, ahead.select("sys", "i", F.col("p").alias("v"))).withColumnRenamed("v", "z")
        along = Kept(ahead.join(image, ["sys", "i"], "left").withColumn("z", F.coalesce("z", F.lit(0.0))))
        curves = along.df.groupBy("sys").agg(F.sum(F.col("p") * F.col("z")).alias("pz"))
        step = F.coalesce(F.try_divide("rr", F.when(F.col("pz") > 0, F.col("pz"))), F.lit(float("nan")))
        moved = along.df.join(curves, "sys").withColumn("step", step)
        now = keep(moved.select("sys", "i", (F.col("v") + F.col("step") * F.col("p")).alias("v"), (F.col("r") - F.col("step") * F.col("z")).alias("r"), "p", F.col("rr").alias("old")))
        along.drop()
        n += 1
    matrix.drop()
    return _out(out, ["sys", "i", "v", "status", "iterations"])


def power_iteration(a: DataFrame, eps: float, most: int, start: DataFrame | None = None, stride: int = STRIDE) -> DataFrame:
    """(sys, i, v, value, error, status, iterations) of the dominant eigenpair, from ``start`` (sys, i, v) or ones.

    A zero start is replaced by 0.1 everywhere.  It ends when three times the relative error is at
    most ``eps``; an image that vanishes fails.  Vectors are scaled and judged once a stride.
    """
    matrix = Bucketed(a, ["sys", "j"], a.count())
    x = start if start is not None else matrix.df.select("sys", "i").distinct().withColumn("v", F.lit(1.0))
    zero = x.groupBy("sys").agg(F.bool_and(F.col("v") == 0).alias("zero"))
    x = Kept(x.join(zero, "sys").select("sys", "i", F.when(F.col("zero"), 0.1).otherwise(F.col("v")).alias("v"))).df
    out, n = [], 0
    while True:
        steps = max(1, min(stride, most - n))
        n += steps
        for _ in range(steps):
            x = matvec(matrix.df, x)
        x = keep(x)
        size = x.groupBy("sys").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
        x = keep(x.join(size, "sys").select("sys", "i", F.try_divide("v", "size").alias("v")))
        both = Kept(x.join(matvec(matrix.df, x).withColumnRenamed("v", "w"), ["sys", "i"]))
        values = both.df.groupBy("sys").agg(F.sum(F.col("v") * F.col("w")).alias("value"))
        gaps = both.df.join(values, "sys").groupBy("sys").agg(F.first("value").alias("value"), F.sqrt(F.sum(F.pow(F.col("w") - F.col("value") * F.col("v"), 2))).alias("gap"))
        error = F.try_divide("gap", F.abs("value"))
        told = keep(gaps.select("sys", "value", error.alias("error"), _told(3 * error, abs(eps), n >= most).alias("status")))
        found = _finished(x, told.select("sys", "status"), n)
        out.append(found.join(told.select("sys", "value", "error"), "sys"))
        both.drop()
        going = told.where("status IS NULL")
        if going.isEmpty():
            break
        x = x.join(going.select("sys"), "sys", "left_semi")
    matrix.drop()
    return _out(out, ["sys", "i", "v", "value", "error", "status", "iterations"])


def gram(rows: DataFrame, group: list[str], features: list[Column], label: Column) -> DataFrame:
    """(group, a, b): each group's normal equations in one aggregation of the upper triangle."""
    m = len(features)
    sums = [F.sum(features[i] * features[j]).alias(f"_a{i}_{j}") for i in range(m) for j in range(i, m)]
    found = rows.groupBy(*group).agg(*sums, *[F.sum(features[i] * label).alias(f"_b{i}") for i in range(m)])
    a = F.array(*[F.array(*[F.col(f"_a{min(i, j)}_{max(i, j)}") for j in range(m)]) for i in range(m)])
    return found.select(*group, a.alias("a"), F.array(*[F.col(f"_b{i}") for i in range(m)]).alias("b"))


def trend(rows: DataFrame, group: list[str], x: Column, y: Column) -> DataFrame:
    """(group, intercept, slope) of least squares in one aggregation; null if all x are equal."""
    return rows.groupBy(*group).agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"))
