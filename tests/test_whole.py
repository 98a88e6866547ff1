"""Systems that a task takes whole, against numpy and against the table forms."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import test_blocked
from lattica.operators import blocked, linear, whole
from lattica.plans import tables


def refuse(*_):
    raise AssertionError("tiles of systems that fit a task")


def path_systems(spark, lengths):
    """The Laplacians of paths: coordinates, sizes, shifts next to the eigenvalue a third of the way up, and starts."""
    cells = [(s, i, j, 2.0 - (i in (0, n - 1)) if i == j else -1.0) for s, n in enumerate(lengths) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n]
    want = {s: 2 - 2 * np.cos(np.pi * (n // 3) / n) for s, n in enumerate(lengths)}
    a = spark.createDataFrame(cells, "sys long, i long, j long, a double")
    sizes = spark.createDataFrame(list(enumerate(lengths)), "sys long, n long")
    shifts = spark.createDataFrame([(s, float(v) + 1e-4) for s, v in want.items()], "sys long, shift double")
    start = spark.createDataFrame([(s, i, float(np.sin(1 + i * i))) for s, n in enumerate(lengths) for i in range(n)], "sys long, i long, v double")
    return a, sizes, shifts, start, want


def test_inverse_iteration_of_many_small_systems_makes_no_tiles(spark, monkeypatch):
    """Each of them was a tile of half a megabyte before, and was broadcast."""
    monkeypatch.setattr(blocked, "tiles", refuse)
    lengths = [4 + s % 60 for s in range(300)]
    *given, want = path_systems(spark, lengths)
    found = blocked.inverse_iteration(*given, 1e-8, 40).collect()
    assert len(found) == sum(lengths) and {r["status"] for r in found} == {"Converged"}
    assert all(abs(r["value"] - want[r["sys"]]) < 1e-7 for r in found)


def test_inverse_iteration_by_bands_and_by_tiles_of_the_same_systems(spark, monkeypatch):
    *given, _ = path_systems(spark, [30, 5, 41])
    by = lambda: {(r["sys"], r["i"]): (r["status"], round(r["value"], 9), r["iterations"]) for r in blocked.inverse_iteration(*given, 1e-8, 40, size=8).collect()}
    whole_ones = by()
    monkeypatch.setattr(blocked, "WHOLE", 5)
    monkeypatch.setattr(whole, "HELD", 130)  # the shortest whole, the longest by tiles
    assert by() == whole_ones and len(whole_ones) == 76


@pytest.mark.parametrize("test", ["test_solve_by_tiles_of_all_sizes", "test_refinement_reaches_the_last_digits", "test_inverse_iteration"])
def test_tiles(spark, monkeypatch, test):
    """The tests of the same operators once more, all systems by tiles."""
    monkeypatch.setattr(blocked, "WHOLE", 0)
    monkeypatch.setattr(whole, "HELD", 0)
    f = getattr(test_blocked, test)
    f(spark, monkeypatch) if "monkeypatch" in f.__code__.co_varnames[: f.__code__.co_argcount] else f(spark)


def test_solve_of_systems_that_fit_makes_no_tiles(spark, monkeypatch):
    monkeypatch.setattr(blocked, "tiles", refuse)
    test_blocked.test_solve_by_tiles_of_all_sizes(spark, monkeypatch)


def test_solve_takes_rows_of_entries(spark, monkeypatch):
    """The rows' form of a matrix, whole and by tiles at once; the product with x gives x back."""
    monkeypatch.setattr(blocked, "WHOLE", 20)
    rows = spark.createDataFrame([(s, i, float(s + i % 5)) for s, n in enumerate((3, 20, 27)) for i in range(n)], "sys long, i long, v double")
    entry = lambda j: F.pmod(F.xxhash64("sys", "i", j), F.lit(2001)) / 1000 - 1
    a = blocked.rows_of(rows, entry)
    b = a.select("sys", "i", F.aggregate(F.zip_with("a", "x", lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v).alias("v"))
    found = {(r["sys"], r["i"]): r for r in blocked.solve(a, b, size=8).collect()}
    assert len(found) == 50 and all(r["status"] == "Converged" and abs(r["v"] - (s + i % 5)) < 1e-9 for (s, i), r in found.items())
    plan = a.groupBy("sys").cogroup(b.groupBy("sys")).applyInArrow(whole.solved(1e-12, 3), "sys long, i long, v double, status string")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and plan.count("Exchange") <= 3  # the entries aren't shuffled: the lists are


@pytest.mark.parametrize("n", [1, 2, 47, 130])
def test_dense_factors(n):
    r = np.random.default_rng(n)
    m = r.normal(size=(n, n))
    np.fill_diagonal(m[: n // 2], 0.0)
    y = r.normal(size=n)
    assert np.allclose(whole.Dense(m).solve(y[None])[0], np.linalg.solve(m, y))
    m[:, n // 2] = 0.0
    assert not whole.Dense(m).ok[0]


@pytest.mark.parametrize("below, above", [(1, 1), (0, 2), (3, 0), (2, 4)])
def test_banded_factors_exchange_rows(below, above):
    """Systems of several lengths together, with small diagonals; a singular one is told."""
    r = np.random.default_rng(below + 7 * above)
    lengths = [25, 9, 25, 1, 14]
    n = max(lengths)
    band, full = np.zeros((len(lengths), n, below + above + 1)), []
    for s, size in enumerate(lengths):
        m = np.array([[r.normal() * (1e-3 if i == j and below and above else 1.0) if -below <= j - i <= above else 0.0 for j in range(size)] for i in range(size)])
        if not (below and above):
            m[np.arange(size), np.arange(size)] += 3.0
        if s == 2:
            m[:, 11] = 0.0
        full.append(m)
        for i in range(n):
            for j in range(max(0, i - below), min(n, i + above + 1)):
                band[s, i, j - i + below] = m[i, j] if max(i, j) < size else float(i == j)
    y = [r.normal(size=size) for size in lengths]
    sides = np.zeros((len(lengths), n))
    for s, v in enumerate(y):
        sides[s, : len(v)] = v
    factors = whole.Banded(band, below)
    assert factors.ok.tolist() == [True, True, False, True, True]
    x = factors.solve(sides)
    for s, size in enumerate(lengths):
        if s != 2:
            assert np.allclose(full[s] @ x[s, :size], y[s], atol=1e-8) and not x[s, size:].any()


@pytest.mark.parametrize("stretch", [1, 300, 1 << 20])
def test_stretches_hold_whole_systems(spark, monkeypatch, stretch):
    monkeypatch.setattr(whole, "STRETCH", stretch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame([(f"s{s}" if s else None, i) for s in range(40) for i in range(1 + s * s % 23)], "sys string, i long")

        def run(table, number):
            assert number[0] == 0 and (np.diff(number) >= 0).all()
            first = np.searchsorted(number, np.arange(number[-1] + 1))
            yield pa.RecordBatch.from_arrays([table.column("sys").combine_chunks().take(pa.array(first)), pa.array(np.bincount(number))], ["sys", "n"])

        found = whole.dealt(rows, 100, run, "sys string, n long").collect()
        assert sorted((r["sys"], r["n"]) for r in found) == sorted((f"s{s}", 1 + s * s % 23) for s in range(1, 40))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def path_cells(spark, lengths, empty):
    """(a, b) of (1 + L / 4) x = y on paths, those of ``empty`` without a cell; the last row of each of its systems has no value."""
    cells = [(f"s{s}", i, j, 1.0 + 0.25 * ((i > 0) + (i < n - 1)) if i == j else -0.25) for s, n in enumerate(lengths) if s not in empty for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n]
    sides = [(f"s{s}", i, None if i == n - 1 else float(np.sin(s + 3 * i))) for s, n in enumerate(lengths) for i in range(n)]
    return spark.createDataFrame(cells, "sys string, i long, j long, a double").repartition(5), spark.createDataFrame(sides, "sys string, i long, v double")


RELAXED = [lambda *s: linear.jacobi(*s), lambda *s: linear.relax(*s, omega=1.1, colours=2), lambda a, b, *s: linear.relax(a, b, *s, omega=1.1, colours=linear.colouring(a))]


@pytest.mark.parametrize("method", RELAXED)
@pytest.mark.parametrize("most", [1, 8, 90])
def test_relaxation_whole_and_by_tables(spark, monkeypatch, method, most):
    """The same rows, statuses and iterations, whether a task takes a system whole, or tables do, or some go either way."""
    a, b = path_cells(spark, [30, 1, 12, 30, 7], {3})
    found = []
    for cells in (1_000_000, 60, 0):
        monkeypatch.setattr(linear, "WHOLE_CELLS", cells)
        found.append({(r["sys"], r["i"]): (r["v"] if r["v"] is None else round(r["v"], 9), r["status"], r["iterations"]) for r in method(a, b, 1e-9, most).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 80
    assert {v[1] for k, v in found[0].items() if k[0] == "s3"} == {"Failed"} and (most < 90 or found[0]["s0", 3][1] == "Converged")


def test_colouring_whole_and_by_tables(spark, monkeypatch):
    r = np.random.default_rng(4)
    cells = [(s, int(i), int(j), 1.0) for s in range(6) for i, j in r.integers(0, 9 + 4 * s, (40, 2))]
    a = spark.createDataFrame(cells, "sys int, i long, j long, a double").repartition(3)
    found = []
    for most in (1_000_000, 39, 0):
        monkeypatch.setattr(linear, "WHOLE_CELLS", most)
        found.append({(x["sys"], x["i"]): x["colour"] for x in linear.colouring(a).collect()})
    assert found[0] == found[1] == found[2] and all(found[0][s, i] != found[0][s, j] for s, i, j, _ in cells if i != j)


def test_small_sparse_systems_are_shuffled_once(spark, monkeypatch):
    """Relaxation and colouring of systems that fit a task take no matrix product of tables, which was a join and an aggregation a step."""
    a, b = path_cells(spark, [30] * 50, set())
    monkeypatch.setattr(linear, "matvec", refuse)
    monkeypatch.setattr(linear, "Bucketed", refuse)
    assert {r["status"] for r in linear.relax(a, b, 1e-9, 90, 1.1, linear.colouring(a)).collect()} == {"Converged"}


@pytest.mark.parametrize("cells", [1_000_000, 0])
def test_relaxation_leaves_its_result_only(spark, monkeypatch, cells):
    """Every stride's vectors stayed on disk before; what stays is a table of the results for each stride at which systems ended, at most."""
    monkeypatch.setattr(linear, "WHOLE_CELLS", cells)
    held, made = set(), tables.Kept.__init__
    drop = tables.Kept.drop
    monkeypatch.setattr(tables.Kept, "__init__", lambda self, *x: (made(self, *x), held.add(self.path))[0])
    monkeypatch.setattr(tables.Kept, "drop", lambda self: (drop(self), held.discard(self.path))[0])
    a, b = path_cells(spark, [30, 30], set())
    found = linear.relax(a, b, 1e-9, 90, stride=2)  # some twelve strides, at the last of which both end
    assert found.agg(F.max("iterations")).first()[0] > 16 and len(held) <= 3
