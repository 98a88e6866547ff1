"""Blocked LU and the tree of R factors against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import blocked, linear, small


def coordinates(spark, systems):
    a = [(s, i, j, float(v)) for s, (m, _) in systems.items() for (i, j), v in np.ndenumerate(m)]
    b = [(s, i, float(v)) for s, (_, x) in systems.items() for i, v in enumerate(x)]
    return spark.createDataFrame(a, "sys long, i long, j long, a double"), spark.createDataFrame(b, "sys long, i long, v double")


def solutions(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["sys"], {})[r["i"]] = (r["v"], r["status"])
    return out


def test_solve_by_tiles_of_all_sizes(spark, monkeypatch):
    """Tournaments of several rounds, systems of several sizes, zeros on the diagonal, singular ones, and one that needs row exchanges between tiles."""
    monkeypatch.setattr(blocked, "FAN", 2)
    r = np.random.default_rng(1)
    systems = {s: (r.normal(size=(n, n)), r.normal(size=n)) for s, n in enumerate([1, 4, 5, 13, 21])}
    np.fill_diagonal(systems[4][0], 0.0)
    systems[5] = (np.eye(9)[::-1] * 3.0, np.arange(9.0))
    singular = r.normal(size=(11, 11))
    singular[:, 4] = 0
    systems[6], systems[7] = (singular, np.ones(11)), (np.zeros((3, 3)), np.ones(3))
    a, b = coordinates(spark, systems)
    found = solutions(blocked.solve(a, b, size=4))
    assert set(found) == set(systems)
    for s, (m, y) in systems.items():
        x = np.array([found[s][i][0] for i in range(len(y))], float)
        assert {found[s][i][1] for i in range(len(y))} == {"Failed" if s > 5 else "Converged"}
        assert np.isnan(x).all() if s > 5 else np.allclose(x, np.linalg.solve(m, y), rtol=1e-9)


def test_refinement_reaches_the_last_digits(spark):
    """A Hilbert matrix with a solution of whole numbers: the residual in twice the precision brings all digits back."""
    n = 8
    scale = float(np.lcm.reduce(range(1, 2 * n)))
    m = scale / (np.arange(n)[:, None] + np.arange(n) + 1)
    y = m @ np.ones(n)
    a, b = coordinates(spark, {0: (m, y)})
    found = solutions(blocked.solve(a, b, eps=1e-15, most=6, size=3))
    assert max(abs(found[0][i][0] - 1) for i in range(n)) < 1e-14 < np.abs(np.linalg.solve(m, y) - 1).max()


def test_residual_keeps_what_rounding_loses(spark):
    a, b = coordinates(spark, {0: (np.array([[1e16, 1.0, -1e16], [1 / 3, 3.0, 0.0]]), np.array([1.0, 1 + 1e-16]))})
    x = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.75), (0, 2, 1.0)], "sys long, i long, v double")
    got = {r["i"]: r["v"] for r in blocked.residual(a, x, b).collect()}
    assert got == {0: 0.25, 1: pytest.approx(1 - 1 / 3 - 2.25, abs=1e-16)}


def test_no_systems(spark):
    a, b = coordinates(spark, {})
    assert blocked.solve(a, b).count() == 0


def test_factors_serve_several_right_hand_sides(spark):
    r = np.random.default_rng(3)
    m = r.normal(size=(10, 10))
    a, _ = coordinates(spark, {2: (m, [])})
    factors = blocked.lu(a, spark.createDataFrame([(2, 10)], "sys long, n long"), size=4)
    for y in (r.normal(size=10), np.eye(10)[3]):
        _, b = coordinates(spark, {2: (m, y)})
        x = {x["i"]: x["v"] for x in factors.solve(b).collect()}
        assert np.allclose([x[i] for i in range(10)], np.linalg.solve(m, y))
    factors.drop()


def test_least_squares_keeps_what_the_normal_equations_lose(spark):
    r = np.random.default_rng(5)
    rows = [(g, float(x)) for g in ("a", "b", None) for x in r.uniform(0, 1, 400)]
    table = spark.createDataFrame(rows, "g string, x double").repartition(7)
    powers = [F.pow("x", F.lit(float(k))) for k in range(10)]
    y = sum((k % 3 + 1) * p for k, p in enumerate(powers))
    found = {x["g"]: x for x in blocked.least_squares(table, ["g"], powers, y).collect()}
    want = [k % 3 + 1 for k in range(10)]
    assert set(found) == {"a", "b", None} and all(np.allclose(x["x"], want, atol=1e-5) and x["residual"] < 1e-9 for x in found.values())
    normal = linear.gram(table.where("g = 'a'"), ["g"], powers, y).select(small.solve(F.col("a"), F.col("b"), 1e-12).alias("x")).first()["x"]
    assert not np.allclose(normal, want, atol=1e-5)


def test_least_squares_of_odd_groups(spark, monkeypatch):
    monkeypatch.setattr(blocked, "FAN", 2)
    monkeypatch.setattr(blocked, "GROUPS_HELD", 1)
    rows = [(1, 1.0, 2.0, 5.0), (1, 2.0, 4.0, 1.0), (1, 3.0, 6.0, 2.0), (2, 1.0, 1.0, 3.0), (3, 1.0, 0.0, 2.0), (3, 0.0, 1.0, 3.0), (3, None, 1.0, 9.0), (4, 1.0, 1.0, 1.0), (4, 1.0, 2.0, 2.0), (4, 1.0, 4.0, 5.0)]
    table = spark.createDataFrame(rows, "g int, u double, v double, y double").repartition(9)
    found = {x["g"]: (x["x"], x["residual"]) for x in blocked.least_squares(table, ["g"], [F.col("u"), F.col("v")], F.col("y")).collect()}
    assert found[1] == (None, None) and found[2] == (None, None) and np.allclose(found[3][0], [2, 3]) and found[3][1] < 1e-12
    x, gap, *_ = np.linalg.lstsq(np.array([[1, 1], [1, 2], [1, 4.0]]), np.array([1, 2, 5.0]), rcond=None)
    assert np.allclose(found[4][0], x) and np.isclose(found[4][1], np.sqrt(gap[0]))
    assert blocked.least_squares(table.limit(0), ["g"], [F.col("u")], F.col("y")).count() == 0


def test_inverse_iteration(spark):
    """The eigenvalue next to each shift, over several tiles; a shift that is an eigenvalue of a diagonal matrix fails."""
    r = np.random.default_rng(8)
    systems = {}
    for s, n in enumerate((1, 5, 9)):
        m = r.normal(size=(n, n))
        systems[s] = (m + m.T, np.zeros(n))
    systems[3] = (np.diag([1.0, 2.0, 3.0]), np.ones(3))
    a, b = coordinates(spark, systems)
    exact = {s: np.linalg.eigvalsh(m)[len(m) // 2] for s, (m, _) in systems.items()}
    shift = {s: 2.0 if s == 3 else v + 1e-3 for s, v in exact.items()}
    sizes = spark.createDataFrame([(s, len(m)) for s, (m, _) in systems.items()], "sys long, n long")
    shifts = spark.createDataFrame(list((s, float(v)) for s, v in shift.items()), "sys long, shift double")
    found = {}
    for x in blocked.inverse_iteration(a, sizes, shifts, b, 1e-9, 30, size=4).collect():
        found.setdefault(x["sys"], {})[x["i"]] = x
    assert {x["status"] for x in found[3].values()} == {"Failed"} and len(found[3]) == 3
    for s in (0, 1, 2):
        m = systems[s][0]
        v = np.array([found[s][i]["v"] for i in range(len(m))])
        assert found[s][0]["status"] == "Converged" and abs(found[s][0]["value"] - exact[s]) < 1e-9 and np.allclose(m @ v, exact[s] * v, atol=1e-7) and np.isclose(v @ v, 1)
    again = blocked.inverse_iteration(a, sizes, shifts, b, 1e-15, 1, size=4)
    assert {x["status"] for x in again.where("sys IN (1, 2)").collect()} == {"MaxIterations"}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50])
def test_symmetric_eigenvalues(spark, n):
    r = np.random.default_rng(n)
    m = r.normal(size=(n, n))
    m = m + m.T
    got = spark.createDataFrame([(m.tolist(),), (np.diag(np.arange(n) + 1.0).tolist(),)], "a array<array<double>>").select(small.symmetric_eigenvalues(F.col("a"), 10).alias("e")).collect()
    assert np.allclose(sorted(got[0]["e"]), np.linalg.eigvalsh(m), atol=1e-10) and sorted(got[1]["e"]) == list(np.arange(n) + 1.0)


@pytest.mark.parametrize("n", [20, 100])
def test_small_solvers_bind_their_sides_once(spark, n):
    """As many unknowns as fit a row comfortably, in a time that doesn't multiply with the refinements."""
    r = np.random.default_rng(n)
    m, x = r.normal(size=(n, n)), r.normal(size=n)
    df = spark.createDataFrame([(m.tolist(), (m @ x).tolist())], "a array<array<double>>, b array<double>")
    solvers = [small.solve(F.col("a"), F.col("b")), small.let(small.qr(F.col("a")), lambda f: small.qr_solve(f, F.col("b")))]
    for got in df.select(*solvers).first():
        assert np.allclose(got, x, atol=1e-9)
