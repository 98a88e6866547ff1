"""Linear algebra, roots, ODEs, quadrature, interpolation and transforms on small fixtures."""

import math
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lattica.operators import banded, interpolants, interpolation, linear, ode, quadrature, roots, small, spectral, status
from lattica.sources import text

R = np.random.default_rng(5)


def zero():
    return F.transform("b", lambda _: F.lit(0.0))


def systems(spark, a, b):
    return spark.createDataFrame([(k, x.tolist(), y.tolist()) for k, (x, y) in enumerate(zip(a, b))], "sys int, a array<array<double>>, b array<double>").coalesce(1)


def solved(spark, a, b, **columns):
    return systems(spark, a, b).select("sys", *[c.alias(k) for k, c in columns.items()]).orderBy("sys").collect()


def test_lu_and_qr(spark):
    a, b = 100 * R.random((6, 5, 5)), R.random((6, 5))
    for r in solved(spark, a, b, lu=small.lu(F.col("a")), x=small.solve(F.col("a"), F.col("b")), qr=small.qr(F.col("a")), y=small.let(small.qr(F.col("a")), lambda f: small.qr_solve(f, F.col("b")))):
        k, m, q, t = r["sys"], np.array(r["lu"]["m"]), np.array(r["qr"]["q"]), np.array(r["qr"]["r"])
        assert r["lu"]["ok"] and np.allclose(a[k][r["lu"]["order"]], (np.tril(m, -1) + np.eye(5)) @ np.triu(m), atol=1e-8)
        assert np.allclose(q @ t, a[k], atol=1e-8) and np.allclose(q @ q.T, np.eye(5), atol=1e-10) and np.allclose(t, np.triu(t))
        assert np.allclose(a[k] @ r["x"], b[k], atol=1e-9) and np.allclose(a[k] @ r["y"], b[k], atol=1e-9)


def test_lu_edge_cases(spark):
    a, b = np.array([[[0.0, 1], [1, 0]], [[1.0, 1], [1, 1]], [[1.0, 0], [0, 0]]]), np.array([[2.0, 3], [1, 1], [1, 1]])
    swap, ones, half = solved(spark, a, b, plain=small.lu(F.col("a"), pivot=False)["ok"], ok=small.lu(F.col("a"))["ok"], x=small.solve(F.col("a"), F.col("b"), 1e-9), qr=small.qr(F.col("a")))
    assert not swap["plain"] and swap["ok"] and swap["x"] == [3, 2]
    assert not ones["ok"] and ones["x"] is None
    assert np.allclose(np.array(half["qr"]["q"]) @ np.array(half["qr"]["r"]), a[2])  # a zero column
    assert solved(spark, np.array([[[4.0]]]), np.array([[2.0]]), x=small.solve(F.col("a"), F.col("b")))[0]["x"] == [0.5]


def spd(n=4, d=3):
    m = R.random((n, d, d))
    return (m + m.transpose(0, 2, 1)) / 2 + 3 * np.eye(d), R.random((n, d))


METHODS = [lambda *s: small.sor(*s, omega=1.0), lambda *s: small.sor(*s, omega=1.7), lambda *s: small.descend(*s, conjugate=False), lambda *s: small.descend(*s, conjugate=True)]


@pytest.mark.parametrize("method", METHODS)
def test_iterative_solvers(spark, method):
    a, b = spd()
    exact = np.linalg.solve(a, b[:, :, None])[:, :, 0]
    for r in solved(spark, a, b, many=method(F.col("a"), F.col("b"), zero(), 1e-6, 200), one=method(F.col("a"), F.col("b"), zero(), 1e-14, 1)):
        assert r["many"]["status"] == "Converged" and np.allclose(r["many"]["result"], exact[r["sys"]], atol=1e-5) and r["one"]["status"] == "MaxIterations"
    near = spark.createDataFrame([(a[0].tolist(), b[0].tolist(), exact[0].tolist())], "a array<array<double>>, b array<double>, x array<double>")
    assert near.select(method(F.col("a"), F.col("b"), F.col("x"), 1e-6, 50).alias("o")).first()["o"]["iterations"] == 0
    assert solved(spark, np.zeros((1, 2, 2)), np.ones((1, 2)), o=method(F.col("a"), F.col("b"), zero(), 1e-6, 5))[0]["o"]["status"] == "Failed"


def test_sor_rejects_omega():
    for method in (lambda: small.sor(None, None, None, 1e-6, 10, 2.0), lambda: linear.relax(None, None, 1e-6, 10, 2.0)):
        with pytest.raises(ValueError):
            method()


def test_eigenvalues(spark):
    a = np.arange(1.0, 10).reshape(1, 3, 3)
    found = solved(spark, a, np.array([[1.0, 2, 3]]), e=F.array_sort(small.qr_eigenvalues(F.col("a"), 60)), near=small.inverse_iteration(F.col("a"), F.col("b"), 15, 1e-9, 100), zero=small.inverse_iteration(F.col("a"), zero(), 15, 1e-9, 100))[0]
    assert np.allclose(found["e"], [-1.11684, 0, 16.1168], atol=1e-4)
    for o in (found["near"], found["zero"]):  # a zero start is replaced
        assert np.isclose(o["result"]["value"], 16.1168, atol=1e-4) and np.allclose(np.abs(o["result"]["vector"]), [0.231971, 0.525322, 0.818673], atol=1e-5)
    assert solved(spark, np.eye(2)[None], np.ones((1, 2)), o=small.inverse_iteration(F.col("a"), F.col("b"), 1.0, 1e-9, 9))[0]["o"]["status"] == "Failed"


def test_distributed_iterations(spark):
    """Three systems of 60 unknowns, one of them with an empty matrix; the two colours of a ring of even length."""
    d = 60
    ring = 4 * np.eye(d) - np.roll(np.eye(d), 1, 0) - np.roll(np.eye(d), -1, 0)
    a, b = np.stack([ring, ring + np.diag(R.random(d)), np.zeros((d, d))]), R.random((3, d))
    ca, cb = linear.coordinates(systems(spark, a, b))
    exact = np.linalg.solve(a[:2], b[:2, :, None]).ravel()
    relaxed = [lambda *s: linear.jacobi(*s), lambda *s: linear.relax(*s, omega=1.1, colours=2), lambda *s: linear.descend(*s, conjugate=False), lambda *s: linear.descend(*s, conjugate=True)]
    for method in relaxed:
        found = method(ca, cb, 1e-9, 90).orderBy("sys", "i").collect()
        assert [r["status"] for r in found] == ["Converged"] * 2 * d + ["Failed"] * d and found[0]["iterations"] > 1
        assert np.allclose([r["v"] for r in found[: 2 * d]], exact, atol=1e-8) and found[-1]["v"] is None
        assert {r["status"] for r in method(ca, cb, 1e-12, 1).where("sys < 2").collect()} == {"MaxIterations"}
        assert method(ca.limit(0), cb.limit(0), 1e-9, 9).count() == 0
    with pytest.raises(ValueError):
        linear.relax(ca, cb, 1e-9, 9, colours=1)
    m, _ = spd(3)
    cm, _ = linear.coordinates(systems(spark, m, np.ones((3, 3))))
    none = spark.createDataFrame([(s, i, 0.0) for s in range(3) for i in range(3)], "sys int, i long, v double")
    for start in (None, none):
        top = linear.power_iteration(cm, 1e-7, 200, start).orderBy("sys", "i").toPandas()
        values, vectors = np.linalg.eigh(m)
        assert np.allclose(top.value[::3], values[:, -1], atol=1e-5) and set(top.status) == {"Converged"}
        assert np.allclose(np.abs(top.v.to_numpy().reshape(3, 3)), np.abs(vectors[:, :, -1]), atol=1e-4)
    assert {r["status"] for r in linear.power_iteration(ca.where("sys = 2"), 1e-6, 12).collect()} == {"Failed"}


def test_least_squares(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0), (0.0, 1.0, 1.0), (1.0, 1.0, 0.0)], "u double, v double, y double").withColumn("g", F.lit(1))
    normal = linear.gram(df, ["g"], [F.col("u"), F.col("v")], F.col("y"))
    assert np.allclose(normal.select(small.solve(F.col("a"), F.col("b")).alias("x")).first()["x"], 1 / 3, atol=1e-8)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_newton(spark):
    f, df = lambda x: x * x * x - 3, lambda x: 3 * x * x
    for solve in (lambda: roots.newton(f, df, F.lit(1.0), 1e-8, 100), lambda: roots.damped_newton(f, df, F.lit(1.0), 1e-8, 100, 1e-2)):
        found = one(spark, solve())
        assert found["status"] == "Converged" and abs(found["result"] - 3 ** (1 / 3)) < 1e-8
    assert one(spark, roots.newton(f, df, F.lit(1.0), 1e-8, 1))["status"] == "MaxIterations"
    assert one(spark, roots.newton(f, df, F.lit(0.0), 1e-8, 9))["status"] == "Failed"
    assert one(spark, roots.damped_newton(f, df, F.lit(0.0), 1e-8, 9, 1e-2))["status"] == "Failed"
    assert one(spark, roots.newton(lambda x: x - 2, lambda x: F.lit(1.0), F.lit(2.0), 1e-8, 9))["iterations"] == 0
    start = F.array(F.lit(1.0), F.lit(2.0))
    g, dg = lambda x: [x[0] * x[0] + x[1] * x[1] - 5, x[0] - x[1] + 1], lambda x: [[2 * x[0], 2 * x[1]], [F.lit(1.0), F.lit(-1.0)]]
    for solve in (lambda f, df, x0, d, most: roots.newton_system(f, df, x0, d, 1e-9, most), lambda f, df, x0, d, most: roots.damped_newton_system(f, df, x0, d, 1e-9, most, 1e-2)):
        found = one(spark, solve(g, dg, start, 2, 100))
        assert np.allclose(found["result"], [1, 2]) and found["iterations"] == 0
        assert np.allclose(one(spark, solve(g, dg, F.array(F.lit(3.0), F.lit(3.0)), 2, 100))["result"], [1, 2])
        assert one(spark, solve(g, dg, F.array(F.lit(3.0), F.lit(3.0)), 2, 1))["status"] == "MaxIterations"
        assert one(spark, solve(g, dg, F.array(F.lit(0.0), F.lit(0.0)), 2, 50))["status"] == "Failed"
        three = one(spark, solve(lambda x: [x[0] - x[1], x[1] - 2 * x[2], x[2] * x[2] - 4], lambda x: [[F.lit(1.0), F.lit(-1.0), F.lit(0.0)], [F.lit(0.0), F.lit(1.0), F.lit(-2.0)], [F.lit(0.0), F.lit(0.0), 2 * x[2]]], F.array(*map(F.lit, [1.0, 1.0, 1.0])), 3, 100))
        assert three["status"] == "Converged" and np.allclose(three["result"], [4, 4, 2])
    with pytest.raises(ValueError):
        roots.damped_newton_system(g, dg, start, 2, 1e-9, 9, 2.0)


def test_status(spark):
    told = lambda r: one(spark, status.outcome(F.lit(r), 1e-3, F.lit(1.0), F.lit(4)))
    assert told(1e-4).asDict() == {"status": "Converged", "result": 1.0, "iterations": 4}
    assert told(1.0).asDict() == {"status": "MaxIterations", "result": 1.0, "iterations": None}
    assert told(float("nan")).asDict() == {"status": "Failed", "result": None, "iterations": None}
    assert one(spark, status.converged_or(F.lit("MaxIterations"), F.lit(1.0), F.lit(2.0))) == 2.0
    assert one(spark, status.successful_or(F.lit("MaxIterations"), F.lit(1.0), F.lit(2.0))) == 1.0
    with pytest.raises(PySparkException):
        one(spark, status.unwrap(F.lit("Failed"), F.lit(1.0)))


def test_ode(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5, 100.0)], "id int, y0 double, dt double, t_end double")
    decay = lambda t, y: -y
    for step, factor in ((ode.euler_step(decay), 0.5), (ode.heun_step(decay), 0.625), (ode.runge_kutta_step(decay), 1 - 0.5 + 0.125 - 0.125 / 6 + 0.0625 / 24)):
        got = ode.solve(df, ["id"], step, F.col("y0"), F.col("dt"), F.col("t_end")).orderBy("step").collect()
        assert len(got) == 201 and math.isclose(got[200]["y"], factor**200, rel_tol=1e-9) and got[200]["t"] == 100.0
    implicit = ode.implicit_euler_step(decay, lambda t, y: F.lit(-1.0))
    assert ode.solve(df, ["id"], implicit, F.col("y0"), F.col("dt"), F.col("t_end")).orderBy(F.desc("step")).first()["y"] < 1e-7
    assert ode.status(df, ["id"], implicit, F.col("y0"), F.col("dt"), F.col("t_end")).first()["status"] == "Converged"
    # y' = t: the implicit rule uses the new time; 0.3 / 0.1 truncates to two steps; t_end < dt leaves the first state.
    grow = ode.solve(df, ["id"], ode.implicit_euler_step(lambda t, y: t, lambda t, y: F.lit(0.0)), F.lit(0.0), F.lit(0.1), F.lit(0.3)).orderBy("step").collect()
    assert [round(r["y"], 9) for r in grow] == [0.0, 0.01, 0.03]
    assert ode.solve(df, ["id"], ode.euler_step(decay), F.col("y0"), F.lit(1.0), F.lit(0.5)).count() == 1


def test_implicit_euler_ends_once_a_state_is_found(spark):
    """A million moves allowed, a few needed: what is allowed but not needed costs little; it was all folded over before."""
    df = spark.createDataFrame([(1, 1.0)], "id int, y0 double")
    run = lambda most: ode.solve(df, ["id"], ode.implicit_euler_step(lambda t, y: -y * y, lambda t, y: -2 * y, 1e-12, most), F.col("y0"), F.lit(0.5), F.lit(30.0)).orderBy("step").collect()
    few, began = run(50), time.monotonic()
    assert run(1_000_000) == few and len(few) == 61 and time.monotonic() - began < 8


@pytest.mark.parametrize("most", range(1, 9))
def test_implicit_euler_takes_as_many_moves_as_allowed(spark, most):
    """One step of y' = -y ** 3 from far away, against the same moves in Python: found at the same number of moves, else NaN."""
    x = 9.0
    gap = lambda x: x - 9.0 + 2.0 * x**3
    for _ in range(most):
        x = x if abs(gap(x)) <= 1e-6 else x - gap(x) / (1 + 6.0 * x * x)
    df = spark.createDataFrame([(1,)], "id int")
    got = ode.solve(df, ["id"], ode.implicit_euler_step(lambda t, y: -y * y * y, lambda t, y: -3 * y * y, 1e-6, most), F.lit(9.0), F.lit(2.0), F.lit(2.0)).orderBy("step").collect()
    assert len(got) == (2 if abs(gap(x)) <= 1e-6 else 1) and (len(got) == 1 or math.isclose(got[1]["y"], x, rel_tol=1e-12))


@pytest.mark.parametrize("method", ["euler", "heun", "runge_kutta", "implicit_euler"])
def test_ode_systems(spark, method):
    field = lambda t, y: [y[1], (1 - y[0] * y[0]) * y[1] - y[0]]
    slopes = lambda t, y: [[F.lit(0.0), F.lit(1.0)], [-2 * y[0] * y[1] - 1, 1 - y[0] * y[0]]]
    step = {"euler": ode.euler_system, "heun": ode.heun_system, "runge_kutta": ode.runge_kutta_system}.get(method)
    step = step(field, 2) if step else ode.implicit_euler_system(field, slopes, 2)
    df = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0])], "id int, y0 array<double>")
    dt = 0.25 if method != "euler" else 0.05
    got = ode.solve_system(df, ["id"], step, F.col("y0"), F.lit(dt), F.lit(25.0)).collect()
    assert len(got) == 2 * (int(25 / dt) + 1) and all(abs(v) < 10 for r in got for v in r["y"]) and all(r["y"] == [0, 0] for r in got if r["id"] == 2)
    if method == "implicit_euler":  # a step that isn't found ends the trajectory
        never = ode.implicit_euler_system(lambda t, y: [y[0] * y[0] + 1e6, F.lit(0.0)], lambda t, y: [[2 * y[0], F.lit(0.0)], [F.lit(0.0), F.lit(0.0)]], 2, most=5)
        assert [r["step"] for r in ode.solve_system(df.limit(1), ["id"], never, F.col("y0"), F.lit(1.0), F.lit(3.0)).collect()] == [0]


def test_residual_is_exact_to_the_last_bit(spark):
    from fractions import Fraction

    a, x = 1e6 * R.random((3, 6, 6)), R.random((3, 6))
    b = np.einsum("nij,nj->ni", a, x)
    want = [[float(Fraction(b[n, i]) - sum(Fraction(a[n, i, j]) * Fraction(x[n, j]) for j in range(6))) for i in range(6)] for n in range(3)]
    df = spark.createDataFrame([(k, a[k].tolist(), x[k].tolist(), b[k].tolist()) for k in range(3)], "k int, a array<array<double>>, x array<double>, b array<double>")
    got = [r["r"] for r in df.orderBy("k").select(small.residual(F.col("a"), F.col("x"), F.col("b")).alias("r")).collect()]
    assert np.allclose(got, want, rtol=1e-9, atol=0)


def test_quadrature(spark):
    exact, a, b = math.e - 1, F.lit(0.0), F.lit(1.0)
    for rule, tolerance in (
        (quadrature.trapezoid(F.exp, a, b), 0.2), (quadrature.kepler(F.exp, a, b), 0.01), (quadrature.composite_trapezoid(F.exp, a, b, 1000), 3e-6),
        (quadrature.simpson(F.exp, a, b, 1000), 3e-12), (quadrature.romberg(F.exp, a, b), 1e-10),
    ):
        assert abs(one(spark, rule) - exact) < tolerance
    with pytest.raises(ValueError):
        quadrature.simpson(F.exp, a, b, 3)
    told = one(spark, quadrature.romberg_outcome(F.exp, a, b, 1e-12))
    assert told["status"] == "Converged" and 3 <= told["iterations"] <= 6
    assert one(spark, quadrature.romberg_outcome(F.sqrt, a, b, 1e-12, levels=4))["status"] == "MaxIterations"
    assert abs(one(spark, quadrature.romberg(F.sqrt, a, b, 1e-7, levels=16)) - 2 / 3) < 1e-5  # slow, so the window of eight levels is passed
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 0.0)], "id int, a double, b double")
    found = {r["id"]: r for r in quadrature.adaptive_trapezoid(df, F.exp, ["id"], "a", "b", 1e-6).collect()}
    assert abs(found[1]["integral"] - exact) < 1e-5 and abs(found[2]["integral"] + exact) < 1e-5 and found[1]["status"] == "Converged"
    jump = quadrature.adaptive_trapezoid(df.limit(1), lambda x: F.when(x < 0.3, 0.0).otherwise(1.0), ["id"], "a", "b", 1e-9, deepest=6).first()
    assert jump["status"] == "MaxIterations" and abs(jump["integral"] - 0.7) < 1e-2
    series = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 2.0), (1, 1.0, 1.0), (2, 5.0, 3.0)], "id int, x double, y double")
    assert {r["id"]: r["integral"] for r in quadrature.sampled(series, ["id"], F.col("x"), F.col("y")).collect()} == {1: 2.0, 2: 0.0}


@pytest.mark.parametrize("method", list(interpolation.METHODS))
def test_polynomials(spark, method):
    points = spark.createDataFrame([(1, float(k), float(k**3 - 2 * k)) for k in range(6)] + [(2, 4.0, 7.0)], "g int, x double, y double")
    series = interpolation.nodes(points, ["g"], "x", "y")
    queries = spark.createDataFrame([(1, -0.5), (1, 2.5), (1, 3.0), (2, 9.0)], "g int, q double")
    got = {(r["g"], r["q"]): r["y"] for r in interpolation.interpolate(series, queries, ["g"], "q", method).collect()}
    for q in (-0.5, 2.5, 3.0):
        assert abs(got[1, q] - (q**3 - 2 * q)) < 1e-9
    assert got[2, 9.0] == 7.0
    grown = series.where("g = 1").withColumn("nodes", interpolation.append(F.slice("nodes", 1, 5), F.lit(5.0), F.lit(115.0)))
    assert grown.first()["nodes"] == series.where("g = 1").first()["nodes"]
    with pytest.raises(PySparkException):
        interpolation.nodes(points.union(points), ["g"], "x", "y").collect()


def test_node_schemes(spark):
    assert one(spark, interpolation.uniform_nodes(F.lit(0.0), F.lit(1.0), 4)) == [0, 0.25, 0.5, 0.75, 1]
    assert np.allclose(one(spark, interpolation.chebyshev_nodes(F.lit(-1.0), F.lit(1.0), 2)), [-math.cos(math.pi / 6), 0, math.cos(math.pi / 6)])


def test_spline(spark):
    knots = spark.createDataFrame([(1, 0.1 * k, math.cos(0.1 * k), -math.sin(5.0)) for k in range(51)], "g int, x double, y double, slope double")
    segments = interpolation.spline_segments(knots, ["g"], "x", "y", 0.0, "slope")
    queries = spark.createDataFrame([(1, 0.01 * k) for k in range(501)], "g int, q double").withColumn("q", F.least("q", F.lit(5.0)))
    got = interpolation.spline(segments, queries, ["g"], "q").collect()
    assert len(got) == 501 and max(abs(r["y"] - math.cos(r["q"])) for r in got) < 1e-5
    with pytest.raises(PySparkException):
        interpolation.spline(segments, spark.createDataFrame([(1, 6.0)], "g int, q double"), ["g"], "q").collect()
    assert interpolation.segments_of_samples(knots, ["g"], "x", "y").count() == 50


@pytest.mark.parametrize("ranges", [1, 7])
def test_as_of_and_nearest(spark, ranges):
    """Over one range and several; groups without points, null groups, a dense stretch, equal places and repeated queries."""
    points = [(g, float(x), f"{g}:{x}") for g in (1, 2, None) for x in sorted(R.choice(100, 30, replace=False))]
    points += [(2, 50 + k / 1e6, f"dense {k:02}") for k in range(1, 60)] + [(1, x, f"{n} of {x}") for x in (200.0, 201.0) for n in "bca"]
    asked = [(g, float(x)) for g in (1, 2, 3, None) for x in (*R.integers(-5, 105, 40), 7.5, 7.5, 50.00003, 200.0, 200.5, 300.0)]
    p, q = spark.createDataFrame(points, "g int, at double, name string").repartition(3), spark.createDataFrame(asked, "g int, x double").repartition(2)
    of = lambda g: [(x, n) for h, x, n in points if h == g]
    plain = {
        (False, False): lambda g, x: max(((a, n) for a, n in of(g) if a <= x), default=(None, None))[1],
        (True, False): lambda g, x: max(((a, n) for a, n in of(g) if a < x), default=(None, None))[1],
        (False, True): lambda g, x: max(((-a, n) for a, n in of(g) if a >= x), default=(None, None))[1],
    }
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        for (strict, forward), want in plain.items():
            got = interpolation.as_of(p, q, ["g"], "at", "x", "s", strict, forward).collect()
            assert len(got) == len(asked) and all((r["s"] and r["s"]["name"]) == want(r["g"], r["x"]) for r in got)
        got = interpolation.nearest(p, q, ["g"], "at", "x").collect()
        assert len(got) == len(asked) and all(not r["nearest"] or abs(r["nearest"]["at"] - r["x"]) == min(abs(a - r["x"]) for a, _ in of(r["g"])) for r in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_as_of_makes_its_inputs_once(spark):
    calls = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: calls.add(1) or x, "double")
    p, q = spark.createDataFrame([(1, 1.0)], "g int, at double"), spark.createDataFrame([(1, 2.0)], "g int, x double")
    found = interpolation.as_of(p.select("g", count("at").alias("at")), q.select("g", count("x").alias("x")), ["g"], "at", "x", "s")
    # Once for the sample of the ranges, once for the rows.
    assert found.collect()[0]["s"]["at"] == 1.0 and calls.value <= 4


@pytest.mark.parametrize("chunk", [4, 128])
def test_tridiagonal(spark, monkeypatch, chunk):
    """Systems of 1 to 700 unknowns, also of a null group, over several levels of chunks."""
    monkeypatch.setattr(banded, "CHUNK", chunk)
    systems = {}
    for k, n in enumerate((1, 2, 3, 4, 5, 9, 130, 700)):
        a, c, r = R.normal(size=n), R.normal(size=n), R.normal(size=n)
        systems[k or None] = (a, np.abs(a) + np.abs(c) + R.uniform(0.1, 1, n), c, r)
    rows = [(s, i, *map(float, e)) for s, parts in systems.items() for i, e in enumerate(zip(*parts))]
    found = {}
    for x in banded.tridiagonal(spark.createDataFrame(rows, "s int, i long, a double, d double, c double, r double").repartition(3), ["s"]).collect():
        found.setdefault(x["s"], {})[x["i"]] = x["x"]
    assert set(found) == set(systems)
    for s, (a, d, c, r) in systems.items():
        want = np.linalg.solve(np.diag(d) + np.diag(a[1:], -1) + np.diag(c[:-1], 1), r)
        assert np.allclose([found[s][i] for i in range(len(r))], want, rtol=1e-10, atol=1e-12)


@pytest.mark.parametrize("chunk", [4, 128])
def test_spline_of_chunks_is_the_spline_of_two_sweeps(spark, monkeypatch, chunk):
    monkeypatch.setattr(banded, "CHUNK", chunk)
    series = {}
    for g, n in ((None, 2), (1, 3), (2, 4), (3, 5), (4, 300)):
        series[g] = (np.cumsum(R.uniform(0.1, 2, n)), R.normal(size=n))
    rows = [(g, float(x), float(y), 0.5, -0.25) for g, (xs, ys) in series.items() for x, y in zip(xs, ys)]
    knots = spark.createDataFrame(rows, "g int, x double, y double, l double, r double").repartition(3)
    pieces = {}
    for s in interpolation.spline_segments(knots, ["g"], "x", "y", "l", "r").collect():
        pieces.setdefault(s["g"], []).append(s)
    for g, (x, y) in series.items():
        h, n = np.diff(x), len(x)
        slopes, gaps = np.r_[0.5, np.diff(y) / h, -0.25], np.r_[0, h, 0]
        upper, m = np.zeros(n), np.zeros(n)
        for i in range(n):
            d = 2 * (gaps[i] + gaps[i + 1]) - (gaps[i] * upper[i - 1] if i else 0)
            upper[i], m[i] = gaps[i + 1] / d, (6 * (slopes[i + 1] - slopes[i]) - (gaps[i] * m[i - 1] if i else 0)) / d
        for i in range(n - 2, -1, -1):
            m[i] -= upper[i] * m[i + 1]
        got = sorted(pieces[g], key=lambda s: s["lo"])
        assert [(s["lo"], s["hi"], s["y_lo"], s["y_hi"], s["first"], s["last"]) for s in got] == [(x[i], x[i + 1], y[i], y[i + 1], i == 0, i == n - 2) for i in range(n - 1)]
        assert np.allclose([(s["m_lo"], s["m_hi"]) for s in got], list(zip(m[:-1], m[1:])))
    for bad in ([(1, 1.0, 0.0)], [(1, 1.0, 0.0), (1, 1.0, 2.0), (1, 3.0, 0.0)]):
        with pytest.raises(PySparkException, match="two knots"):
            interpolation.spline_segments(spark.createDataFrame(bad, "g int, x double, y double"), ["g"], "x", "y").collect()


def test_transforms(spark):
    def signal(values):
        return spark.createDataFrame([(1, n, float(v)) for n, v in enumerate(values)], "g int, n int, x double")

    for values in ([1] + [0] * 14, [0, 0, 1, 0], list(range(8)), [3]):
        size = spectral.next_power(len(values))
        want = np.fft.fft(np.pad(np.array(values, float), (0, size - len(values))))
        for found in (spectral.dft(signal(values), ["g"], "n", "x", len(values)), spectral.fft(signal(values), ["g"], "n", "x")):
            got = found.orderBy("k").collect()
            assert np.allclose([complex(r["re"], r["im"]) for r in got], want, atol=1e-9)
    with pytest.raises(ValueError):
        spectral.next_power(0)


def test_long_transforms_in_stages(spark):
    """Series of one to three stages together, one of a null group, with samples left out."""
    series = {1: R.normal(size=1), 2: R.normal(size=40), None: R.normal(size=100), 4: R.normal(size=5000)}
    rows = [(g, n, float(v)) for g, values in series.items() for n, v in enumerate(values) if n % 7 != 3 or n == len(values) - 1]
    found = {}
    for x in spectral.fft(spark.createDataFrame(rows, "g int, n int, x double").repartition(3), ["g"], "n", "x").collect():
        found.setdefault(x["g"], {})[x["k"]] = complex(x["re"], x["im"])
    for g, values in series.items():
        size = spectral.next_power(len(values))
        held = np.array([v if n % 7 != 3 or n == len(values) - 1 else 0 for n, v in enumerate(values)])
        assert np.allclose([found[g][k] for k in range(size)], np.fft.fft(held, size), atol=1e-9)


def test_colours_of_any_graph(spark):
    """Odd rings, grids with diagonals, stars, complete graphs and one-sided entries: no equation holds two unknowns of a colour."""
    graphs = {0: [(k, (k + 1) % 7) for k in range(7)], 1: [(0, k) for k in range(1, 60)], 2: [(i, j) for i in range(6) for j in range(i)], 3: [(5 * y + x, 5 * (y + dy) + x + dx) for y in range(5) for x in range(5) for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)) if y + dy < 5 and 0 <= x + dx < 5]}
    size = {s: max(max(e) for e in edges) + 1 for s, edges in graphs.items()}
    cells = [(s, i, j, -1.0) for s, edges in graphs.items() for i, j in edges] + [(s, i, i, 70.0) for s, n in size.items() for i in range(n)]
    a = spark.createDataFrame(cells, "sys int, i long, j long, a double").repartition(3)
    colours = linear.colouring(a)
    colour = {(r["sys"], r["i"]): r["colour"] for r in colours.collect()}
    assert all(colour[s, i] != colour[s, j] for s, edges in graphs.items() for i, j in edges) and set(colour) == {(s, i) for s, n in size.items() for i in range(n)}
    top = {s: max(c for (g, _), c in colour.items() if g == s) for s in graphs}
    assert top[0] == 2 and top[1] == 1 and top[2] == 5 and 3 <= top[3] <= 8
    assert {(r["sys"], r["i"]): r["colour"] for r in linear.colouring(a.repartition(7)).collect()} == colour
    x = {k: float(v) for k, v in zip(sorted(colour), R.normal(size=len(colour)))}
    b = linear.matvec(a, spark.createDataFrame([(s, i, v) for (s, i), v in x.items()], "sys int, i long, v double"))
    for r in linear.relax(a, b, 1e-10, 60, omega=1.1, colours=colours).collect():
        assert r["status"] == "Converged" and abs(r["v"] - x[r["sys"], r["i"]]) < 1e-9
    with pytest.raises(ValueError, match="one colour"):
        linear.relax(a, b, 1e-9, 9, colours=colours.withColumn("colour", F.lit(0)))


def test_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (0, "a"), (2, None)], "pos int, v string")
    text.write_values(df, f"file://{tmp_path}/one", "pos", "v")
    assert [r[0] for r in text.read_values(spark, f"file://{tmp_path}/one").collect()] == ["a", "b", ""]
    text.write_pairs(df, df.where("pos < 2"), f"file://{tmp_path}/two", "pos", "v")
    assert sorted(tuple(r) for r in text.read_pairs(spark, f"file://{tmp_path}/two").collect()) == [("a", "a"), ("b", "b")]
    text.write_pairs(df, spark.createDataFrame([(70, "y"), (50, "x")], "pos int, v string"), f"file://{tmp_path}/three", "pos", "v")
    assert sorted(tuple(r) for r in text.read_pairs(spark, f"file://{tmp_path}/three").collect()) == [("a", "x"), ("b", "y")]


@pytest.mark.parametrize("name", ["barycentric", "neville", "newton", "spline"])
def test_interpolation_of_whole_series(spark, tmp_path, name):
    """A query in each gap of series of 1, 2, 5 and 40 events; also against a dense solution of the spline's system."""
    import datetime

    from lattica.plans import registry

    day, start, events = 86400.0, datetime.datetime(2024, 1, 1), []
    for user, n in enumerate((1, 2, 5, 40)):
        at = np.cumsum(R.integers(3600, 86400, n))
        events += [(len(events) + i, user, start + datetime.timedelta(seconds=int(at[i])), 100 * math.sin(at[i] / day)) for i in range(n)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["user_id"], r["gap"]): r["y"] for r in registry.queries()[f"interp_{name}_whole"](spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 0)} | {(2, g) for g in range(4)} | {(3, g) for g in range(39)}
    for user in (1, 2, 3):
        x = np.array([(e[2] - start).total_seconds() / day for e in events if e[1] == user])
        x, y, n = x - x[0], np.array([e[3] / 100 for e in events if e[1] == user]), len(x)
        h = np.diff(x)
        slopes = np.concatenate([[0], np.diff(y) / h, [0]])
        gaps = np.concatenate([[0], h, [0]])
        m = np.linalg.solve(np.diag(2 * (gaps[:-1] + gaps[1:])) + np.diag(h, 1) + np.diag(h, -1), 6 * np.diff(slopes))
        for g in range(n - 1):
            if name == "spline":
                t, lo = 0.3 * h[g], y[g]
                want = lo + t * ((y[g + 1] - lo) / h[g] - h[g] * (2 * m[g] + m[g + 1]) / 6) + t**2 * m[g] / 2 + t**3 * (m[g + 1] - m[g]) / (6 * h[g])
            else:
                piece = slice(g - g % 3, g - g % 3 + 4)
                want = np.polyval(np.polyfit(x[piece] - x[g], y[piece], len(x[piece]) - 1), 0.4 * h[g])
            assert abs(got[user, g] - want) < 1e-3


@pytest.mark.parametrize("method", list(interpolants.VALUES))
def test_stored_interpolants(spark, method):
    rng = np.random.default_rng(3)
    first = [(g, float(x), float(rng.normal())) for g in (1, 2, None) for x in rng.permutation(8)[:3]]
    late = [(g, float(x), float(rng.normal())) for g in (1, None, 3) for x in (9, -2, 11)] + [(1, None, 1.0), (4, 2.0, None)]
    kind = "g int, x double, y double"
    stored = interpolants.build(spark.createDataFrame(first, kind), ["g"], "x", "y")
    grown = interpolants.extend(stored, spark.createDataFrame(late, kind), ["g"], "x", "y")
    every = [r for r in first + late if None not in r[1:]]
    asked = [(g, q) for g in (1, 2, 3, None, 4) for q in (0.3, 9.0, -1.5, None)]
    got = {(r["g"], r["q"]): r["y"] for r in interpolants.evaluate(grown, spark.createDataFrame(asked, "g int, q double"), ["g"], "q", method).collect()}
    assert set(got) == {a for a in asked if a[0] != 4}
    for (g, q), y in got.items():
        xs, ys = zip(*[(x, v) for k, x, v in every if k == g])
        want = None if q is None else sum(v * math.prod((q - o) / (x - o) for o in xs if o != x) for x, v in zip(xs, ys))
        assert y == (None if want is None else pytest.approx(want, abs=1e-7)), (g, q)
    rebuilt = interpolants.build(spark.createDataFrame(every, kind), ["g"], "x", "y")
    sizes = lambda df: {r["g"]: len(r["interpolant"]["w"]) for r in df.collect()}
    assert sizes(rebuilt) == sizes(grown) == {1: 6, 2: 3, 3: 3, None: 6}
    with pytest.raises(Exception, match="this x already"):
        interpolants.extend(stored, spark.createDataFrame([first[0]], kind), ["g"], "x", "y").collect()
    assert interpolants.build(spark.createDataFrame([], kind), ["g"], "x", "y").count() == 0
