"""Dense systems beyond the row: LU with tournament pivoting on a table of square tiles, and least squares by a tree of R factors.

A matrix is a table (sys, t, j, tile, free): ``tile`` holds the numbers of rows t * size ... and columns j * size ..., and ``free`` tells
which of these rows haven't been a pivot.  Rows aren't moved; a pivot row is copied out of its tile and not touched again.
One step of the elimination handles one column of tiles:

1. each tile proposes as many of its free rows as it has columns, by elimination with row pivoting; proposals play a tournament, FAN of
   them a match, and the winners' own elimination gives the pivots and their factors;
2. the tile column becomes multipliers (a join with the factors), the pivots' rows of each other tile column become rows of U (an aggregation of one
   tile's rows);
3. all tiles to the right lose the product of both: a join by tile row and one by tile column.

Many systems, of different sizes, go together.  A task holds a few tiles at a time; numpy works inside a tile, and Spark moves the tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators import whole
from lattica.plans.tables import Kept

#: Rows and columns of a tile, and proposals in one match of a tournament.
TILE, FAN = 256, 16
#: Unknowns of a system that one task factors whole, without tiles.
WHOLE = 5 * TILE
TINY = 1e-16

_TILE = "sys long, t long, j long, tile binary, free binary"


def _numbers(raw: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, columns)


def eliminate(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """(order of rows, factors, ok) of a tall or square matrix by row pivoting; the factors are U and below it the multipliers of L.

    A column without a pivot is passed over, so the first rows of the order span the others; ``ok`` tells that there was none.
    """
    m, order, r, ok = a.copy(), np.arange(len(a)), 0, True
    for k in range(m.shape[1]):
        if r == len(m):
            break
        p = r + int(np.argmax(np.abs(m[r:, k])))
        if not abs(m[p, k]) >= TINY:
            ok = False
            continue
        if p != r:
            m[[r, p]], order[[r, p]] = m[[p, r]], order[[p, r]]
        m[r + 1 :, k] /= m[r, k]
        m[r + 1 :, k + 1 :] -= np.outer(m[r + 1 :, k], m[r, k + 1 :])
        r += 1
    return order, m, ok


def _lower_solve(factors: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of L x = b, L with ones on its diagonal."""
    x = b.copy()
    for k in range(len(factors)):
        x[k + 1 :] -= np.outer(factors[k + 1 :, k], x[k])
    return x


def _upper_solve(factors: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of U x = b."""
    x = b.copy()
    for k in range(len(factors) - 1, -1, -1):
        x[k] /= factors[k, k]
        x[:k] -= np.outer(factors[:k, k], x[k])
    return x


def _value(cell: pa.Scalar) -> object:
    """A cell as Python has it, lists of numbers as arrays."""
    if pa.types.is_list(cell.type):
        return cell.values.to_numpy(zero_copy_only=False) if cell.is_valid else np.zeros(0)
    return cell.as_py()


def _per_row(run: Callable[[dict], dict | None], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row in, one out or none; a row holds a tile or a few, so each is a record batch of its own."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                made = run({name: _value(batch.column(c)[k]) for c, name in enumerate(batch.schema.names)})
                if made is not None:
                    yield pa.RecordBatch.from_pylist([made], schema)

    return over


def _schema(**fields: pa.DataType) -> pa.Schema:
    return pa.schema(list(fields.items()))


def tiles(a: DataFrame, sizes: DataFrame, size: int = TILE) -> DataFrame:
    """(sys, t, j, tile, free) of coordinates (sys, i, j, a); ``sizes`` is (sys, n).  Missing entries are zero, and the last tiles go on as the unit matrix."""

    def fill(row: dict) -> dict:
        tile = np.zeros((size, size))
        np.add.at(tile.reshape(-1), row["places"].astype(int), row["values"])
        if row["t"] == row["j"]:
            beyond = np.arange(max(0, min(size, row["n"] - row["t"] * size)), size)
            tile[beyond, beyond] = 1.0
        return {"sys": row["sys"], "t": row["t"], "j": row["j"], "tile": tile.tobytes(), "free": b"\x01" * size}

    place = lambda c: F.floor(F.col(c) / size).cast("long")
    entry = F.struct((F.col("i") % size * size + F.col("j") % size).cast("int").alias("at"), F.col("a").cast("double").alias("a"))
    known = a.where("a != 0").select("sys", place("i").alias("t"), place("j").alias("j"), entry.alias("e")).groupBy("sys", "t", "j").agg(F.collect_list("e").alias("e"))
    known = known.select("sys", "t", "j", F.col("e.at").alias("places"), F.col("e.a").alias("values"))
    last = F.ceil(F.col("n") / size).cast("long") - 1
    grid = sizes.select("sys", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("t")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    schema = _schema(sys=pa.int64(), t=pa.int64(), j=pa.int64(), tile=pa.binary(), free=pa.binary())
    return grid.join(known, ["sys", "t", "j"], "left").mapInArrow(_per_row(fill, schema), _TILE)


_PROPOSAL = "sys long, match long, rows binary, numbers binary"


def _propose(size: int):
    def run(row: dict) -> dict | None:
        free = np.flatnonzero(np.frombuffer(row["free"], np.uint8))
        if not len(free):
            return None
        panel = _numbers(row["tile"], size)[free]
        best = eliminate(panel)[0][:size]
        return {"sys": row["sys"], "match": row["t"] // FAN, "rows": (row["t"] * size + free[best]).tobytes(), "numbers": panel[best].tobytes()}

    return _per_row(run, _schema(sys=pa.int64(), match=pa.int64(), rows=pa.binary(), numbers=pa.binary()))


def _gathered(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers of a match, in the order of the rows, so that ties don't depend on who comes first."""
    rows = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("rows").to_pylist()])
    numbers = np.concatenate([_numbers(x, size) for x in table.column("numbers").to_pylist()])
    order = np.argsort(rows)
    return rows[order], numbers[order]


def _match(size: int):
    def run(table: pa.Table) -> pa.Table:
        rows, numbers = _gathered(table, size)
        best = eliminate(numbers)[0][:size]
        return pa.table({"sys": table.column("sys")[:1], "match": pa.array([table.column("match")[0].as_py() // FAN]), "rows": pa.array([rows[best].tobytes()]), "numbers": pa.array([numbers[best].tobytes()])})

    return run


def _final(size: int):
    def run(table: pa.Table) -> pa.Table:
        rows, numbers = _gathered(table, size)
        order, factors, ok = eliminate(numbers)
        return pa.table({"sys": table.column("sys")[:1], "rows": pa.array([rows[order[:size]].tobytes()]), "factors": pa.array([factors[:size].tobytes()]), "ok": pa.array([ok])})

    return run


class Factors:
    """Factors of many systems as tables, for any number of right-hand sides; ``drop`` them in the end.

    ``pivots`` (sys, k, rows, factors, ok), ``lower`` (sys, k, t, tile) and ``upper`` (sys, k, j, tile), each a list with one table a step.
    """

    def __init__(self, sizes: DataFrame, size: int):
        self.sizes, self.size = sizes, size
        self.pivots: list[Kept] = []
        self.lower: list[Kept] = []
        self.upper: list[Kept] = []
        self.failed: DataFrame | None = None

    def drop(self) -> None:
        for table in (*self.pivots, *self.lower, *self.upper):
            table.drop()

    def solve(self, b: DataFrame) -> DataFrame:
        """(sys, i, v) of ``b`` (sys, i, v); missing entries are zero.  Systems whose factors aren't ok, or that ``b`` has nothing of, are left out."""
        size = self.size
        last = F.ceil(F.col("n") / size).cast("long") - 1
        parts = self.sizes.join(b.select("sys").distinct(), "sys", "left_semi").join(self.failed, "sys", "left_anti").select("sys", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("t"))
        known = b.select("sys", F.floor(F.col("i") / size).cast("long").alias("t"), F.struct((F.col("i") % size).cast("int").alias("at"), F.col("v").cast("double").alias("v")).alias("e")).groupBy("sys", "t").agg(F.collect_list("e").alias("e"))
        known = known.select("sys", "t", F.col("e.at").alias("places"), F.col("e.v").alias("values"))

        def fill(row: dict) -> dict:
            v = np.zeros(size)
            np.add.at(v, row["places"].astype(int), row["values"])
            return {"sys": row["sys"], "t": row["t"], "v": v.tobytes()}

        vector = _schema(sys=pa.int64(), t=pa.int64(), v=pa.binary())
        names = "sys long, t long, v binary"
        rest = Kept(parts.join(known, ["sys", "t"], "left").mapInArrow(_per_row(fill, vector), names))
        sides: list[Kept] = []

        def picked(table: pa.Table) -> pa.Table:
            """The pivots' entries, out of the parts of the right-hand side that hold them."""
            rows = np.frombuffer(table.column("rows")[0].as_py(), np.int64)
            parts = dict(zip(table.column("t").to_pylist(), table.column("v").to_pylist()))
            v = np.array([np.frombuffer(parts[r // size], np.float64)[r % size] for r in rows.tolist()])
            y = _lower_solve(_numbers(table.column("factors")[0].as_py(), size), v[:, None])
            return pa.table({"sys": table.column("sys")[:1], "v": pa.array([y.tobytes()])})

        def less(row: dict) -> dict:
            v = np.frombuffer(row["v"], np.float64) - _numbers(row["tile"], size) @ np.frombuffer(row["y"], np.float64)
            return {"sys": row["sys"], "t": row["t"], "v": v.tobytes()}

        # Forward: the pivots' entries of the right-hand side, then all other rows lose their multiples.
        for pivots, lower in zip(self.pivots, self.lower):
            here = _pivot_tiles(pivots.df, size).select("sys", "t", "rows", "factors")
            y = Kept(here.join(rest.df, ["sys", "t"]).groupBy("sys").applyInArrow(picked, "sys long, v binary"))
            sides.append(y)
            then = Kept(rest.df.join(lower.df, ["sys", "t"]).join(y.df.withColumnRenamed("v", "y"), "sys").select("sys", "t", "v", "tile", "y").mapInArrow(_per_row(less, vector), names))
            rest.drop()
            rest = then
        rest.drop()

        def back(row: dict) -> dict:
            x = _upper_solve(_numbers(row["factors"], size), np.frombuffer(row["v"], np.float64)[:, None])
            return {"sys": row["sys"], "v": x.tobytes()}

        def summed(table: pa.Table) -> pa.Table:
            v = np.frombuffer(table.column("v")[0].as_py(), np.float64).copy()
            parts = sorted(zip(table.column("j").to_pylist(), table.column("tile").to_pylist(), table.column("x").to_pylist()), key=lambda p: p[0])
            for _, tile, x in parts:
                if tile is not None:
                    v -= _numbers(tile, size) @ np.frombuffer(x, np.float64)
            return pa.table({"sys": table.column("sys")[:1], "v": pa.array([v.tobytes()])})

        # Backward: a step's unknowns from those of the steps after it.
        found: DataFrame | None = None
        kept: list[Kept] = []
        for k in range(len(self.pivots) - 1, -1, -1):
            side = sides[k].df
            if found is not None:
                products = self.upper[k].df.join(found, ["sys", "j"]).select("sys", "j", "tile", "x")
                side = side.join(products, "sys", "left").select("sys", "v", "j", "tile", "x").groupBy("sys").applyInArrow(summed, "sys long, v binary")
            x = side.join(self.pivots[k].df, "sys").select("sys", "v", "factors").mapInArrow(_per_row(back, _schema(sys=pa.int64(), v=pa.binary())), "sys long, v binary")
            kept.append(Kept(x.select("sys", F.lit(k).cast("long").alias("j"), F.col("v").alias("x"))))
            found = kept[-1].df if found is None else found.union(kept[-1].df)
        for table in sides:
            table.drop()
        if found is None:
            return b.select(F.col("sys").cast("long"), F.col("i").cast("long"), F.col("v").cast("double")).limit(0)
        return found.mapInArrow(_unpacked(size), "sys long, i long, v double").join(self.sizes, "sys").where("i < n").select("sys", "i", "v")


def _unpacked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                v = np.frombuffer(batch.column(2)[k].as_py(), np.float64)
                start = batch.column(1)[k].as_py() * size
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * size, pa.int64()), pa.array(np.arange(start, start + size)), pa.array(v)], ["sys", "i", "v"])

    return run


def _pivot_tiles(pivots: DataFrame, size: int) -> DataFrame:
    """(sys, t, rows, factors): the pivots of each system, a row for each tile that holds some."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for t in np.unique(np.frombuffer(row["rows"], np.int64) // size).tolist():
                    yield pa.RecordBatch.from_pylist([{"sys": row["sys"], "t": t, "rows": row["rows"], "factors": row["factors"]}], _schema(sys=pa.int64(), t=pa.int64(), rows=pa.binary(), factors=pa.binary()))

    return pivots.select("sys", "rows", "factors").mapInArrow(split, "sys long, t long, rows binary, factors binary")


def _multipliers(size: int):
    def run(row: dict) -> dict:
        factors, tile = _numbers(row["factors"], size), _numbers(row["tile"], size)
        left = _upper_transposed(factors, tile) * _after(row, size)[:, None]
        return {"sys": row["sys"], "t": row["t"], "tile": left.tobytes()}

    return _per_row(run, _schema(sys=pa.int64(), t=pa.int64(), tile=pa.binary()))


def _upper_transposed(factors: np.ndarray, a: np.ndarray) -> np.ndarray:
    """x of x U = a."""
    x = a.copy()
    for k in range(len(factors)):
        x[:, k] /= factors[k, k]
        x[:, k + 1 :] -= np.outer(x[:, k], factors[k, k + 1 :])
    return x


def _after(row: dict, size: int) -> np.ndarray:
    """Which rows of a tile are free once the step's pivots are taken."""
    free = np.frombuffer(row["free"], np.uint8).copy()
    rows = np.frombuffer(row["rows"], np.int64)
    free[rows[rows // size == row["t"]] % size] = 0
    return free


def _pivot_rows(size: int):
    """Each tile's pivot rows, with their places among the pivots."""

    def run(row: dict) -> dict:
        rows = np.frombuffer(row["rows"], np.int64)
        mine = np.flatnonzero(rows // size == row["t"])
        return {"sys": row["sys"], "j": row["j"], "at": mine.tobytes(), "numbers": _numbers(row["tile"], size)[rows[mine] % size].tobytes(), "factors": row["factors"]}

    return _per_row(run, _schema(sys=pa.int64(), j=pa.int64(), at=pa.binary(), numbers=pa.binary(), factors=pa.binary()))


def _upper(size: int):
    def run(table: pa.Table) -> pa.Table:
        tile = np.zeros((size, size))
        for at, numbers in zip(table.column("at").to_pylist(), table.column("numbers").to_pylist()):
            tile[np.frombuffer(at, np.int64)] = _numbers(numbers, size)
        done = _lower_solve(_numbers(table.column("factors")[0].as_py(), size), tile)
        return pa.table({"sys": table.column("sys")[:1], "j": table.column("j")[:1], "tile": pa.array([done.tobytes()])})

    return run


def _trailing(size: int):
    def run(row: dict) -> dict:
        left = _numbers(row["tile"], size) - _numbers(row["lower"], size) @ _numbers(row["upper"], size)
        return {"sys": row["sys"], "t": row["t"], "j": row["j"], "tile": left.tobytes(), "free": _after(row, size).tobytes()}

    return _per_row(run, _schema(sys=pa.int64(), t=pa.int64(), j=pa.int64(), tile=pa.binary(), free=pa.binary()))


def lu(a: DataFrame, sizes: DataFrame, size: int = TILE) -> Factors:
    """Factors of coordinate matrices (sys, i, j, a) of (sys, n); ``failed`` lists the systems in which a pivot was below TINY."""
    sizes = Kept(sizes.where("n > 0").select("sys", F.col("n").cast("long").alias("n"))).df
    made, work = Factors(sizes, size), Kept(tiles(a, sizes, size))
    steps = -(-(sizes.agg(F.max("n")).first()[0] or 0) // size)
    bad: list[DataFrame] = []
    for k in range(steps):
        panel = work.df.where(F.col("j") == k)
        proposals = panel.mapInArrow(_propose(size), _PROPOSAL)
        matches = -(-steps // FAN)
        while matches > 1:  # as many rounds as the logarithm of the tiles
            proposals = proposals.groupBy("sys", "match").applyInArrow(_match(size), _PROPOSAL)
            matches = -(-matches // FAN)
        chosen = Kept(proposals.groupBy("sys").applyInArrow(_final(size), "sys long, rows binary, factors binary, ok boolean"))
        made.pivots.append(chosen)
        bad.append(chosen.df.where("NOT ok").select("sys"))
        good = chosen.df.where("ok")
        lower = Kept(panel.join(good, "sys").select("sys", "t", "tile", "free", "rows", "factors").mapInArrow(_multipliers(size), "sys long, t long, tile binary"))
        made.lower.append(lower)
        ahead = work.df.where(F.col("j") > k)
        rows = ahead.join(_pivot_tiles(good, size), ["sys", "t"]).select("sys", "t", "j", "tile", "rows", "factors").mapInArrow(_pivot_rows(size), "sys long, j long, at binary, numbers binary, factors binary")
        upper = Kept(rows.groupBy("sys", "j").applyInArrow(_upper(size), "sys long, j long, tile binary"))
        made.upper.append(upper)
        if k + 1 < steps:
            both = ahead.join(lower.df.withColumnRenamed("tile", "lower"), ["sys", "t"]).join(upper.df.withColumnRenamed("tile", "upper"), ["sys", "j"]).join(good.select("sys", "rows"), "sys")
            then = Kept(both.select("sys", "t", "j", "tile", "free", "lower", "upper", "rows").mapInArrow(_trailing(size), _TILE))
            work.drop()
            work = then
    work.drop()
    made.failed = Kept(_all(bad).distinct()).df if bad else sizes.select("sys").limit(0)
    return made


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """(sys, i, v): b - a x of coordinate tables, as if summed in twice the precision.

    Products are split into halves of 26 bits, so what rounding loses is known; a row's terms are folded RUN entries at a time, then the
    runs' sums and losses.
    """

    def halves(v: Column) -> tuple[Column, Column]:
        c = v * 134217729.0  # 2**27 + 1
        return c - (c - v), v - (c - (c - v))

    def add(s: Column, v: Column, lost: Column) -> Column:
        total = s["v"] + v
        moved = total - s["v"]
        return F.struct(total.alias("v"), (s["e"] + ((s["v"] - (total - moved)) + (v - moved)) + lost).alias("e"))

    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("e"))
    fold = lambda terms: F.aggregate(terms, zero, lambda s, p: add(s, p["v"], p["e"]))
    (ah, al), (xh, xl) = halves(F.col("a")), halves(F.col("x"))
    product = F.col("a") * F.col("x")
    term = F.struct((-product).alias("v"), (-(((ah * xh - product) + ah * xl + al * xh) + al * xl)).alias("e"))
    terms = a.join(x.select("sys", F.col("i").alias("j"), F.col("v").alias("x")), ["sys", "j"]).select("sys", "i", F.floor(F.col("j") / RUN).alias("run"), term.alias("p"))
    sides = b.select("sys", "i", F.lit(-1).cast("long").alias("run"), F.struct(F.col("v").cast("double").alias("v"), F.lit(0.0).alias("e")).alias("p"))
    runs = terms.union(sides).groupBy("sys", "i", "run").agg(fold(F.array_sort(F.collect_list("p"))).alias("p"))
    return runs.groupBy("sys", "i").agg(fold(F.array_sort(F.collect_list("p"))).alias("p")).select("sys", "i", (F.col("p.v") + F.col("p.e")).alias("v"))


#: Entries of a row that are folded at once.
RUN = 1024


def solve(a: DataFrame, b: DataFrame, eps: float = 1e-12, most: int = 3, size: int = TILE) -> DataFrame:
    """(sys, i, v, status) of a x = b for coordinate tables (sys, i, j, a) and (sys, i, v), by LU and refinement.

    The unknowns are 0 to the largest index of either table; entries that aren't there are zero.  Refinement ends once a correction's norm is at most ``eps`` times
    the solution's, or after ``most`` (MaxIterations).  A singular matrix fails; its values are null.

    A row of ``a`` may hold many entries of a matrix's row, if j and a are arrays (``rows_of``), which moves a third of the bytes.  Systems of at most WHOLE unknowns are solved
    whole by a task, without tiles; ``a`` is read twice, and isn't shuffled if it is dealt by ``sys`` already.
    """
    listed = isinstance(a.schema["j"].dataType, T.ArrayType)
    a, b = a.select(F.col("sys").cast("long").alias("sys"), F.col("i").cast("long").alias("i"), "j", "a"), b.select(F.col("sys").cast("long").alias("sys"), F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))
    if not listed:
        a = a.where("a != 0")
    top = lambda df, c: df.groupBy("sys").agg((F.max(c) + 1).alias("n"))
    sizes = Kept(top(a, F.greatest("i", F.array_max("j") if listed else F.col("j"))).union(top(b, F.col("i"))).groupBy("sys").agg(F.max("n").alias("n"))).df
    large = sizes.where(F.col("n") > WHOLE)
    none_large = large.isEmpty()
    pick = lambda df, how: df if none_large else df.join(large.select("sys"), "sys", how)
    sides = [pick(df, "left_anti").where("sys IS NOT NULL").groupBy("sys") for df in (a, b)]
    found = Kept(sides[0].cogroup(sides[1]).applyInArrow(whole.solved(eps, most), "sys long, i long, v double, status string")).df
    if none_large:
        return found
    rest = pick(a, "left_semi")
    if listed:
        rest = rest.select("sys", "i", F.explode(F.arrays_zip("j", "a")).alias("e")).select("sys", "i", "e.j", "e.a").where("a != 0")
    return found.union(_solve_by_tiles(rest, pick(b, "left_semi"), large, eps, most, size))


def _solve_by_tiles(a: DataFrame, b: DataFrame, sizes: DataFrame, eps: float, most: int, size: int) -> DataFrame:
    a, b = Kept(a.select("sys", "i", "j", "a")), Kept(b.select("sys", "i", "v"))
    factors = lu(a.df, sizes, size)
    x = Kept(factors.solve(b.df))
    done: list[DataFrame] = []
    left = sizes.join(factors.failed, "sys", "left_anti").select("sys")
    for k in range(most):
        within = b.df.join(left, "sys", "left_semi")
        gap = Kept(residual(a.df.join(left, "sys", "left_semi"), x.df, within))
        z = Kept(factors.solve(gap.df).join(left, "sys", "left_semi"))
        moved = Kept(x.df.join(z.df.withColumnRenamed("v", "z"), ["sys", "i"]).select("sys", "i", (F.col("v") + F.col("z")).alias("v"), "z"))
        told = Kept(moved.df.groupBy("sys").agg((F.sum(F.col("z") * F.col("z")) <= eps * eps * F.sum(F.col("v") * F.col("v"))).alias("close"))).df
        done.append(moved.df.join(told.where("close"), "sys", "left_semi").select("sys", "i", "v", F.lit("Converged").alias("status")))
        open_ = told.where("NOT close").select("sys")
        if k + 1 == most or open_.isEmpty():
            done.append(moved.df.join(open_, "sys", "left_semi").select("sys", "i", "v", F.lit("MaxIterations").alias("status")))
            break
        x, left = Kept(moved.df.join(open_, "sys", "left_semi").select("sys", "i", "v")), open_
    none = sizes.join(factors.failed, "sys", "left_semi").select("sys", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"), F.lit(None).cast("double").alias("v"), F.lit("Failed").alias("status"))
    factors.drop()
    return _all([*done, none]) if done else x.df.withColumn("status", F.lit("MaxIterations")).union(none)


def inverse_iteration(a: DataFrame, sizes: DataFrame, shifts: DataFrame, start: DataFrame, eps: float, most: int, size: int = TILE) -> DataFrame:
    """(sys, i, v, value, error, status, iterations) of the eigenvalue next to each system's shift, by one factorisation and a solution a step.

    ``sizes`` is (sys, n), ``shifts`` (sys, shift) and ``start`` (sys, i, v); a start of zero is replaced by 0.1 everywhere.  It ends when three times the relative
    error is at most ``eps``; systems that are done leave the iteration, and a singular a - shift fails.

    Systems of at most WHOLE unknowns, or whose factors' bands have at most ``whole.HELD`` entries, are iterated whole by a task, many together; greater ones by tiles.
    """
    long = lambda c, name=None: F.col(c).cast("long").alias(name or c)
    a = a.where("a != 0").select(long("sys"), long("i"), long("j"), F.col("a").cast("double").alias("a"))
    sizes = sizes.select(long("sys"), long("n"))
    bands = a.groupBy("sys").agg(F.max(F.col("i") - F.col("j")).alias("below"), F.max(F.col("j") - F.col("i")).alias("above"), F.count("*").alias("cells"))
    entries = F.col("n") * (2 * F.greatest("below", F.lit(0)) + F.greatest("above", F.lit(0)) + 1)
    sizes = Kept(sizes.join(bands, "sys", "left").select("sys", "n", F.coalesce("cells", F.lit(0)).alias("cells"), ((F.col("n") <= WHOLE) | (F.coalesce(entries, "n") <= whole.HELD)).alias("fits"))).df
    count, all_fit = sizes.agg(F.sum(F.col("cells") + F.col("n")), F.bool_and("fits")).first()
    row = lambda kind, i, j, v: ["sys", F.lit(kind).alias("kind"), i, j, v]
    none = F.lit(0).cast("long").alias("j")
    pick = lambda df, fits: df if all_fit else df.join(sizes.where(F.col("fits") == fits).select("sys"), "sys", "left_semi")
    start, shifts = start.select(long("sys"), long("i"), F.col("v").cast("double").alias("v")), shifts.select(long("sys"), F.col("shift").cast("double").alias("shift"))
    rows = pick(a, True).select(row(whole.CELL, "i", "j", "a")).union(pick(start, True).select(row(whole.SIDE, "i", none, F.col("v").alias("a"))))
    rows = rows.union(sizes.where("fits AND n > 0").join(shifts, "sys", "left").select(row(whole.SIZE, F.col("n").alias("i"), none, F.coalesce("shift", F.lit(0.0)).alias("a"))))
    found = Kept(whole.dealt(rows, count or 0, whole.inverse_iterated(eps, most), "sys long, i long, v double, value double, error double, status string, iterations int")).df
    if all_fit is not False:
        return found
    return found.union(_inverse_iteration_by_tiles(pick(a, False), sizes.where("NOT fits").select("sys", "n"), shifts, pick(start, False), eps, most, size))


def _inverse_iteration_by_tiles(a: DataFrame, sizes: DataFrame, shifts: DataFrame, start: DataFrame, eps: float, most: int, size: int) -> DataFrame:
    a, sizes = Kept(a.select("sys", "i", "j", "a")).df, Kept(sizes.select("sys", F.col("n").cast("long").alias("n"))).df
    every = sizes.select("sys", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    diagonal = every.join(shifts, "sys").select("sys", "i", F.col("i").alias("j"), (-F.col("shift")).alias("a"))
    factors = lu(a.union(diagonal), sizes, size)
    x = every.join(start.select("sys", "i", "v"), ["sys", "i"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    zero = x.groupBy("sys").agg(F.bool_and(F.col("v") == 0).alias("zero"))
    x = Kept(x.join(zero, "sys").select("sys", "i", F.when(F.col("zero"), 0.1).otherwise(F.col("v")).alias("v"))).df
    failed = x.join(factors.failed, "sys", "left_semi").select("sys", "i", *[F.lit(None).cast("double").alias(c) for c in ("v", "value", "error")], F.lit("Failed").alias("status"), F.lit(None).cast("int").alias("iterations"))
    done, now = [failed], Kept(x.join(factors.failed, "sys", "left_anti")).df
    for n in range(1, most + 1):
        if now.isEmpty():
            break
        z = Kept(factors.solve(now)).df
        norm = z.groupBy("sys").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
        z = Kept(z.join(norm, "sys").select("sys", "i", (F.col("v") / F.col("norm")).alias("v"))).df
        image = a.join(z.select("sys", F.col("i").alias("j"), "v"), ["sys", "j"]).groupBy("sys", "i").agg(F.sum(F.col("a") * F.col("v")).alias("w"))
        both = Kept(z.join(image, ["sys", "i"], "left").withColumn("w", F.coalesce("w", F.lit(0.0))))
        values = both.df.groupBy("sys").agg(F.sum(F.col("v") * F.col("w")).alias("value"))
        gaps = both.df.join(values, "sys").groupBy("sys").agg(F.first("value").alias("value"), F.sqrt(F.sum(F.pow(F.col("w") - F.col("value") * F.col("v"), 2))).alias("gap"))
        error = F.try_divide("gap", F.abs("value"))
        status = F.when(error.isNull() | F.isnan(error), "Failed").when(3 * error <= eps, "Converged").when(F.lit(n == most), "MaxIterations")
        told = Kept(gaps.select("sys", "value", error.alias("error"), status.alias("status"))).df
        ended = z.join(told.where("status IS NOT NULL"), "sys")
        done.append(ended.select("sys", "i", "v", "value", "error", "status", F.when(F.col("status") == "Converged", F.lit(n)).alias("iterations")))
        both.drop()
        now = Kept(z.join(told.where("status IS NULL"), "sys", "left_semi")).df
    factors.drop()
    return _all(done)


def least_squares(rows: DataFrame, group: list[str], features: list[Column], label: Column) -> DataFrame:
    """(group, x, residual, rank_ok): each group's least squares by a tree of R factors, without the normal equations.

    Each task folds its rows of a group into the triangular factor of [features, label]; factors meet FAN at a time.  So the condition isn't squared,
    however many rows there are, and a group of any size sends one small factor a task.  ``x`` is null where the columns depend on each other
    (a diagonal below 1e-13 of the column's norm) or rows are fewer than features; rows with a null are left out.  ``residual`` is the norm of what is left.
    """
    m = len(features)
    keys = F.struct(*group)
    kind = rows.select(keys.alias("key")).schema["key"].dataType.simpleString()
    plain = rows.select(F.to_json(keys, {"ignoreNullFields": "false"}).alias("name"), F.array(*[f.cast("double") for f in features], label.cast("double")).alias("row")).where(F.forall("row", lambda v: v.isNotNull()))

    def out(held: dict[str, np.ndarray], part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int64()), pa.array([r.tobytes() for r in held.values()], pa.binary())], ["name", "part", "r"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else 0
            names = batch.column(0).dictionary_encode()
            codes, texts = names.indices.to_numpy(), names.dictionary.to_pylist()
            numbers = batch.column(1).flatten().to_numpy().reshape(-1, m + 1)
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.r_[True, codes[order][1:] != codes[order][:-1], True]) if len(order) else np.zeros(1, int)
            for s, e in zip(cuts[:-1], cuts[1:]):
                name = texts[codes[order[s]]]
                own = numbers[order[s:e]]
                held[name] = np.linalg.qr(np.vstack([held[name], own]) if name in held else own, mode="r")
            if len(held) > GROUPS_HELD:
                yield out(held, part)
                held = {}
        if held:
            yield out(held, part)

    def meet(table: pa.Table) -> pa.Table:
        stacked = np.vstack([_numbers(r, m + 1) for r in sorted(table.column("r").to_pylist())])
        return pa.table({"name": table.column("name")[:1], "part": pa.array([table.column("part")[0].as_py() // FAN]), "r": pa.array([np.linalg.qr(stacked, mode="r").tobytes()])})

    schema = "name string, part long, r binary"
    parts = Kept(plain.select("name", "row", F.spark_partition_id().cast("long").alias("part")).mapInArrow(fold, schema).withColumn("part", F.floor(F.col("part") / FAN)))
    most, found = parts.df.agg(F.max("part")).first()[0] or 0, parts.df
    while True:
        found = found.groupBy("name", "part").applyInArrow(meet, schema)
        if most == 0:
            break
        most //= FAN

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, gaps = [], []
            for raw in batch.column(2).to_pylist():
                r = _numbers(raw, m + 1)
                if len(r) < m or not (np.abs(np.diag(r[:, :m])) > 1e-13 * np.sqrt((r[:, :m] ** 2).sum(0))).all():
                    xs.append(None)
                    gaps.append(None)
                    continue
                xs.append(_upper_solve(r[:m, :m], r[:m, m:])[:, 0].tolist())
                gaps.append(float(abs(r[m, m])) if len(r) > m else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(xs, pa.list_(pa.float64())), pa.array(gaps, pa.float64())], ["name", "x", "residual"])

    solved = found.mapInArrow(finish, "name string, x array<double>, residual double")
    return solved.select(F.from_json("name", kind).alias("key"), "x", "residual").select("key.*", "x", "residual")


#: Groups whose factors a task holds before it sends them on.
GROUPS_HELD = 20_000


def rows_of(rows: DataFrame, a: Callable[[Column], Column]) -> DataFrame:
    """(sys, i, v, j, a, x) of ``rows`` (sys, i, v): the square matrix of all pairs within a system, a row in a row.

    ``j`` are the system's numbers in their order, ``x`` their values, and ``a`` is made of each j, sys and i.  A system's numbers are gathered, its rows are made where they are,
    so only ``rows`` are shuffled; a task has about a million entries, or one system's.
    """
    m = rows.groupBy("sys").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-int(m) // 1_000_000))
    lists = rows.repartition(tasks, "sys").groupBy("sys").agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("i"), F.col("v").alias("v")))).alias("e"))
    each = lists.select("sys", F.col("e.i").alias("j"), F.col("e.v").alias("x"), F.explode("e").alias("e")).select("sys", "e.i", "e.v", "j", "x")
    return each.select("sys", "i", "v", "j", F.transform("j", a).alias("a"), "x")


def coordinates_of(rows: DataFrame, a: Column) -> DataFrame:
    """(sys, i, j, a) of ``rows`` (sys, i), the square matrix of all pairs within a system; ``a`` may use i and j."""
    columns = rows.select("sys", F.col("i").alias("j"))
    return rows.join(columns, "sys").select("sys", "i", "j", a.alias("a"))
