"""Systems that fit a task, whole: they are dealt out by system once, and a task iterates all of a stretch's systems together in numpy.

The table forms (``linear``, ``blocked``) take systems of any size, but cost a job or more a step; these take a step of many systems for a few
array operations.  ``linear`` and ``blocked`` send each system where it fits: the bounds are on one system's cells, never on how many there are.
Indices are compared, never used as places, so they may have gaps; direct solvers take 0 to n - 1, as ``blocked`` does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of rows that a task takes for one stretch, if no system is larger, and rows of a task, about.
STRETCH, TASK_ROWS = 8 << 20, 500_000
#: Entries of the factors that are held at once, for systems of narrow bands.
HELD = 1 << 20
TINY = 1e-16


def dealt(rows: DataFrame, count: int, run: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` for stretches of whole systems: it gets the rows and each row's number of its system (0, 1, ...); ``count`` is about the number of rows.

    A task holds a stretch, or one system if that is larger.
    """

    def numbers(table: pa.Table) -> np.ndarray:
        s = table.column("sys").combine_chunks()
        return np.r_[0, np.cumsum(pc.not_equal(s.slice(1), s.slice(0, len(s) - 1)).to_numpy(zero_copy_only=False))]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, enough = [], 0, STRETCH
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < enough:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            number = numbers(table)
            cut = int(np.searchsorted(number, number[-1]))
            if cut:
                yield from run(table.slice(0, cut), number[:cut])
            held, size = table.slice(cut).to_batches(), table.nbytes * (len(number) - cut) // len(number)
            enough = max(STRETCH, 2 * size)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from run(table, numbers(table))

    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_ROWS))
    return rows.where("sys IS NOT NULL").repartition(tasks, "sys").sortWithinPartitions("sys").mapInArrow(over, schema)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column, nulls as zero, which is what sums make of them."""
    return pc.fill_null(table.column(name), 0).to_numpy()


class _Places:
    """Numbers of pairs (system, index), by search among those that there are."""

    def __init__(self, system: np.ndarray, index: np.ndarray):
        self.order = np.lexsort((index, system))
        self.values = np.unique(index)
        self.keys = self._key(system, index)[0][self.order]

    def _key(self, system: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.values, index), max(0, len(self.values) - 1))
        known = self.values[at] == index if len(self.values) else np.zeros(len(index), bool)
        return system * len(self.values) + at, known

    def of(self, system: np.ndarray, index: np.ndarray) -> np.ndarray:
        """The place in the order of (system, index), or -1."""
        key, known = self._key(system, index)
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return np.where(known & (self.keys[at] == key), at, -1) if len(self.keys) else np.full(len(key), -1)


#: What a row of a stretch is: a cell of the matrix (i, j, a), a right-hand side or a start (i, a), a colour (i, j), a size and a shift (i, a).
CELL, SIDE, COLOUR, SIZE = range(4)


def relaxed(eps: float, most: int, omega: float, colours: int | None, number: int, sweeps: int):
    """Of rows (sys, kind, i, j, a): (sys, i, v, status, iterations) by Jacobi's method or over-relaxation, as ``linear.relax`` does it.

    ``colours`` is a modulus (0: Jacobi's method) or None, if rows tell the colours; there are ``number`` of them, and statuses are looked at every ``sweeps``
    sweeps.  A system that has an equation with two unknowns of a colour comes back as one row of status Clash.
    """

    def run(table: pa.Table, system: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind, i, j, a = (_numbers(table, c) for c in ("kind", "i", "j", "a"))
        side, cell = np.flatnonzero(kind == SIDE), np.flatnonzero(kind == CELL)
        places = _Places(system[side], i[side])
        side = side[places.order]
        of, b = system[side], a[side]
        at_system, at_i, at_j, a = system[cell], i[cell], j[cell], a[cell]
        off = at_i != at_j
        if colours is None:
            told = np.flatnonzero(kind == COLOUR)
            coloured = _Places(system[told], i[told])
            names = np.r_[j[told][coloured.order], -1]
            one, two = names[coloured.of(at_system, at_i)], names[coloured.of(at_system, at_j)]
            clash, colour = off & (one == two) & (one >= 0), np.maximum(0, names[coloured.of(of, i[side])])
        elif colours:
            clash, colour = off & (at_i % colours == at_j % colours), i[side] % colours
        else:
            clash, colour = np.zeros(len(off), bool), np.zeros(len(side), np.int64)
        count = int(system[-1]) + 1
        if clash.any():
            first = np.searchsorted(system, np.unique(at_system[clash]))
            yield _rows(table, first, i[first], np.full(len(first), np.nan), np.full(len(first), "Clash"), np.full(len(first), -1))
            return
        r, c = places.of(at_system, at_i), places.of(at_system, at_j)
        d = np.full(len(side), np.nan)
        d[r[~off & (r >= 0)]] = a[~off & (r >= 0)]
        v, status, iterations = np.zeros(len(side)), np.full(count, "Failed", dtype="<U13"), np.full(count, -1)
        failed = np.zeros(count, bool)
        failed[of[np.isnan(d)]] = True
        inside = (r >= 0) & (c >= 0)
        r, c, a, off = r[inside], c[inside], a[inside], off[inside]
        # Unknowns (x, of, b, d, colour) and cells (r, c, a, off) of the systems that go on; ``mine`` says which unknowns they are.
        mine, going = np.arange(len(side)), ~failed
        x, n, first = np.zeros(len(side)), 0, True
        with np.errstate(all="ignore"):
            while True:
                if first or going[of].mean() < 0.7:
                    stays = going[of]
                    new = np.cumsum(stays) - 1
                    fits = stays[r] if len(r) else np.zeros(0, bool)
                    r, c, a, off = new[r[fits]], new[c[fits]], a[fits], off[fits]
                    mine, x, of, b, d, colour = mine[stays], x[stays], of[stays], b[stays], d[stays], colour[stays]
                    groups = []
                    for k in range(max(1, number)):
                        rows = np.flatnonzero(colour == k)
                        within = np.flatnonzero(off & (colour[r] == k))
                        where = np.zeros(len(x), np.int64)
                        where[rows] = np.arange(len(rows))
                        groups.append((rows, where[r[within]], c[within], a[within]))
                    first = False
                if not len(x):
                    break
                gap = np.bincount(r, a * x[c], minlength=len(x)) - b
                norm = np.sqrt(np.bincount(of, gap * gap, minlength=count))
                bad = np.isnan(norm)
                done = going & (bad | (norm <= eps) | (n >= most))
                status[done] = np.where(bad, "Failed", np.where(norm <= eps, "Converged", "MaxIterations"))[done]
                iterations[done & (status == "Converged")] = n
                ended = done[of]
                v[mine[ended]] = x[ended]
                going &= ~done
                if not going[of].any():
                    break
                steps = min(sweeps, most - n)
                for _ in range(steps):
                    for rows, row, column, value in groups:
                        x[rows] = (1 - omega) * x[rows] + omega * (b[rows] - np.bincount(row, value * x[column], minlength=len(rows))) / d[rows]
                n += steps
        of = system[side]
        yield _rows(table, side, i[side], np.where(status[of] == "Failed", np.nan, v), status[of], iterations[of])

    return run


def _rows(table: pa.Table, at: np.ndarray, i: np.ndarray, v: np.ndarray, status: np.ndarray, iterations: np.ndarray) -> pa.RecordBatch:
    none = status == "Failed"
    columns = [table.column("sys").combine_chunks().take(pa.array(at)), pa.array(i), pa.array(v, mask=none), pa.array(status.tolist(), pa.string()), pa.array(iterations.astype(np.int32), mask=iterations < 0)]
    return pa.RecordBatch.from_arrays(columns, ["sys", "i", "v", "status", "iterations"])


def coloured(table: pa.Table, system: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of cells (sys, i, j, h, g), h and g the hashes of i and j: (sys, i, colour) by the rounds of ``linear.colouring``."""
    i, j, h, g = (_numbers(table, c) for c in ("i", "j", "h", "g"))
    system, index, hashed, at = np.r_[system, system], np.r_[i, j], np.r_[h, g], np.r_[np.arange(len(i)), np.arange(len(i))]
    order = np.lexsort((index, system))
    new = np.r_[True, (np.diff(system[order]) != 0) | (np.diff(index[order]) != 0)]
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(new) - 1
    order = order[new]
    index, hashed, at, n = index[order], hashed[order], at[order], len(order)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((index, hashed))] = np.arange(n)
    u, w = node[: len(i)], node[len(i) :]
    u, w = np.r_[u, w][np.r_[u, w] != np.r_[w, u]], np.r_[w, u][np.r_[u, w] != np.r_[w, u]]
    colour = np.full(n, -1, np.int32)
    open_ = np.ones(n, bool)
    while open_.any():
        loses = np.zeros(n, bool)
        loses[u[open_[w] & (rank[w] > rank[u])]] = True
        left, least = open_ & ~loses, 0
        ours = left[u]
        near, other = u[ours], colour[w[ours]]
        while left.any():
            taken = np.zeros(n, bool)
            taken[near[other == least]] = True
            now = left & ~taken
            colour[now] = least
            left &= ~now
            least += 1
        open_ &= colour < 0
        stays = open_[u]  # a node that has its colour asks no more
        u, w = u[stays], w[stays]
    yield pa.RecordBatch.from_arrays([table.column("sys").combine_chunks().take(pa.array(at)), pa.array(index), pa.array(colour)], ["sys", "i", "colour"])


def factored(a: np.ndarray, panel: int = 48) -> tuple[np.ndarray, np.ndarray] | None:
    """(order of rows, L below and U above) of a square matrix by row pivoting, a panel of columns at a time; None if a pivot is below TINY."""
    m, order, n = a.copy(), np.arange(len(a)), len(a)
    for s in range(0, n, panel):
        e = min(n, s + panel)
        for k in range(s, e):
            p = k + int(np.argmax(np.abs(m[k:, k])))
            if not abs(m[p, k]) >= TINY:
                return None
            if p != k:
                m[[k, p]], order[[k, p]] = m[[p, k]], order[[p, k]]
            m[k + 1 :, k] /= m[k, k]
            m[k + 1 :, k + 1 : e] -= m[k + 1 :, k, None] * m[k, k + 1 : e]
        for k in range(s, e):
            m[k + 1 : e, e:] -= m[k + 1 : e, k, None] * m[k, e:]
        m[e:, e:] -= m[e:, s:e] @ m[s:e, e:]
    return order, m


class Dense:
    """Factors of one dense matrix, for ``solve`` of right-hand sides (1, n)."""

    def __init__(self, a: np.ndarray):
        found = factored(a)
        self.ok = np.array([found is not None])
        self.order, self.m = found or (np.arange(len(a)), np.eye(len(a)))

    def solve(self, b: np.ndarray) -> np.ndarray:
        m, x = self.m, b[0, self.order]
        for k in range(len(x)):
            x[k + 1 :] -= m[k + 1 :, k] * x[k]
        for k in range(len(x) - 1, -1, -1):
            x[k] /= m[k, k]
            x[:k] -= m[:k, k] * x[k]
        return x[None]


class Banded:
    """Factors of many banded matrices at once by row pivoting, for ``solve`` of right-hand sides (systems, n); shorter ones go on as the unit matrix.

    ``band`` is (systems, n, below + above + 1): row r holds the columns r - below to r + above.
    """

    def __init__(self, band: np.ndarray, below: int):
        s, n, w = band.shape
        self.below, self.rows, every = below, np.arange(s), np.arange(s)
        self.pivot, self.lower, self.upper, self.ok = np.zeros((n, s), np.int64), np.zeros((n, s, below)), np.zeros((n, s, w)), np.ones(s, bool)
        work = np.zeros((s, below + 1, w))  # the rows that a step may exchange, from its column on
        for t in range(min(n, below + 1)):
            work[:, t, : w - below + t] = band[:, t, below - t :]
        for k in range(n):
            p = np.argmax(np.abs(work[:, :, 0]), axis=1)
            top = work[every, p].copy()
            fine = np.abs(top[:, 0]) >= TINY
            self.ok &= fine
            top[~fine, 0] = 1.0
            work[every, p] = work[:, 0]
            multiplier = work[:, 1:, 0] / top[:, 0, None]
            work[:, 1:, 1:] -= multiplier[:, :, None] * top[:, None, 1:]
            self.pivot[k], self.lower[k], self.upper[k] = p, multiplier, top
            work[:, :-1, :-1], work[:, :-1, -1] = work[:, 1:, 1:].copy(), 0.0
            work[:, -1] = band[:, k + below + 1] if k + below + 1 < n else 0.0

    def solve(self, b: np.ndarray) -> np.ndarray:
        (s, n), w = b.shape, self.upper.shape[2]
        x = np.zeros((n + w, s))
        x[:n] = b.T
        for k in range(n):
            at = k + self.pivot[k]
            y = x[at, self.rows]
            x[at, self.rows] = x[k]
            x[k] = y
            x[k + 1 : k + 1 + self.below] -= self.lower[k].T * y
        x[n:] = 0.0
        for k in range(n - 1, -1, -1):
            x[k] = (x[k] - np.einsum("sw,ws->s", self.upper[k][:, 1:], x[k + 1 : k + w])) / self.upper[k][:, 0]
        return x[:n].T


def inverse_iterated(eps: float, most: int):
    """Of rows (sys, kind, i, j, a): (sys, i, v, value, error, status, iterations) of the eigenvalue next to the shift, as ``blocked.inverse_iteration`` does it."""

    def run(table: pa.Table, system: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind, i, j, a = (_numbers(table, c) for c in ("kind", "i", "j", "a"))
        heads = np.flatnonzero(kind == SIZE)
        size, shift = np.zeros(int(system[-1]) + 1, np.int64), np.zeros(int(system[-1]) + 1)
        size[system[heads]], shift[system[heads]] = i[heads], a[heads]
        inside = (i >= 0) & (i < size[system]) & ((kind != CELL) | ((j >= 0) & (j < size[system])))
        cell = np.flatnonzero((kind == CELL) & inside)
        start = np.flatnonzero((kind == SIDE) & inside)
        below, above = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        np.maximum.at(below, system[cell], i[cell] - j[cell])
        np.maximum.at(above, system[cell], j[cell] - i[cell])
        narrow = 4 * (2 * below + above + 1) <= size
        # Systems of like size and bands go together.
        likes: dict[tuple, list[int]] = {}
        for s in np.flatnonzero(size > 0).tolist():
            like = (int(below[s]), int(above[s]), int(size[s] - 1).bit_length(), int(size[s]) * 4 >> int(size[s]).bit_length()) if narrow[s] else (s,)
            likes.setdefault(like, []).append(s)
        for like, members in likes.items():
            n = int(size[members].max())
            each = max(1, HELD // (n * (2 * like[0] + like[1] + 1))) if len(like) > 1 else 1
            for k in range(0, len(members), each):
                some = np.array(members[k : k + each])
                place = np.full(len(size), -1)
                place[some] = np.arange(len(some))
                own = cell[place[system[cell]] >= 0]
                s, r, c, value = place[system[own]], i[own], j[own], a[own]
                x = np.zeros((len(some), n))
                held = start[place[system[start]] >= 0]
                np.add.at(x, (place[system[held]], i[held]), a[held])
                real = np.arange(n) < size[some][:, None]
                if len(like) > 1:
                    band = np.zeros((len(some), n, like[0] + like[1] + 1))
                    np.add.at(band, (s, r, c - r + like[0]), value)
                    band[:, :, like[0]] += np.where(real, -shift[some][:, None], 1.0)
                    factors = Banded(band, like[0])
                else:
                    dense = np.zeros((n, n))
                    np.add.at(dense, (r, c), value)
                    dense[np.arange(n), np.arange(n)] -= shift[some[0]]
                    factors = Dense(dense)
                yield _pairs(table, heads[np.searchsorted(system[heads], some)], real, _iterate(factors, s * n + r, s * n + c, value, x, real, eps, most))

    return run


def _iterate(factors: Dense | Banded, r: np.ndarray, c: np.ndarray, a: np.ndarray, x: np.ndarray, real: np.ndarray, eps: float, most: int) -> tuple:
    """(vectors, values, errors, statuses, iterations); ``r``, ``c`` and ``a`` are the cells at places of the flat vectors."""
    m = len(x)
    x = np.where((x == 0).all(1)[:, None] & real, 0.1, x)
    vector, value, error = np.full(x.shape, np.nan), np.full(m, np.nan), np.full(m, np.nan)
    status, iterations, going = np.full(m, "Failed", dtype="<U13"), np.full(m, -1), factors.ok.copy()
    with np.errstate(all="ignore"):
        for n in range(1, most + 1):
            if not going.any():
                break
            z = factors.solve(np.where(going[:, None], x, 0.0))
            x = z / np.sqrt((z * z).sum(1))[:, None]
            w = np.bincount(r, a * x.reshape(-1)[c], minlength=x.size).reshape(x.shape)
            quotient = (x * w).sum(1)
            gap = w - quotient[:, None] * x
            off = np.where(quotient == 0, np.nan, np.sqrt((gap * gap).sum(1)) / np.abs(quotient))
            told = np.where(np.isnan(off), "Failed", np.where(3 * off <= eps, "Converged", "MaxIterations" if n == most else ""))
            done = going & (told != "")
            vector[done], value[done], error[done], status[done] = x[done], quotient[done], off[done], told[done]
            iterations[done & (told == "Converged")] = n
            going &= ~done
    return vector, value, error, status, iterations


def _pairs(table: pa.Table, heads: np.ndarray, real: np.ndarray, found: tuple) -> pa.RecordBatch:
    vector, value, error, status, iterations = found
    s, i = np.nonzero(real)
    null = lambda x: pa.array(x, mask=np.isnan(x))
    columns = [table.column("sys").combine_chunks().take(pa.array(heads[s])), pa.array(i), null(vector[s, i]), null(value[s]), null(error[s]), pa.array(status[s].tolist(), pa.string()), pa.array(iterations[s].astype(np.int32), mask=iterations[s] < 0)]
    return pa.RecordBatch.from_arrays(columns, ["sys", "i", "v", "value", "error", "status", "iterations"])


def residual(a: np.ndarray, x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """b - a x, as if summed in twice the precision: what products and sums lose by rounding is known, and added in the end."""

    def halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = v * 134217729.0  # 2**27 + 1
        return c - (c - v), v - (c - (c - v))

    total, lost = b.copy(), np.zeros(len(b))
    for k in range(len(x)):
        product = a[:, k] * x[k]
        (ah, al), (xh, xl) = halves(a[:, k]), halves(x[k])
        sum_ = total - product
        moved = sum_ - total
        lost += ((total - (sum_ - moved)) + (-product - moved)) - (((ah * xh - product) + ah * xl + al * xh) + al * xl)
        total = sum_
    return total + lost


def solved(eps: float, most: int):
    """Of one system's rows (sys, i, j, a), j and a numbers or lists of them, and (sys, i, v): (sys, i, v, status), as ``blocked.solve`` does it."""

    def run(matrix: pa.Table, sides: pa.Table) -> pa.Table:
        i, j, a = (matrix.column(c).combine_chunks() for c in ("i", "j", "a"))
        at = i.to_numpy()
        if pa.types.is_list(j.type):
            at = np.repeat(at, j.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            j, a = j.flatten(), a.flatten()
        j, a = j.to_numpy(zero_copy_only=False), pc.fill_null(a, 0.0).to_numpy(zero_copy_only=False)
        row, b = _numbers(sides, "i"), _numbers(sides, "v")
        n = int(max(at.max(initial=-1), j.max(initial=-1), row.max(initial=-1))) + 1
        m, right = np.zeros((n, n), order="F"), np.zeros(n)
        np.add.at(m, (at, j), a)
        np.add.at(right, row, b)
        factors = Dense(m)
        name = (matrix if matrix.num_rows else sides).column("sys")[0].as_py()
        if factors.ok[0] and not sides.num_rows:
            n = 0
        status, x = "Failed", np.full(n, np.nan)
        with np.errstate(all="ignore"):
            if factors.ok[0] and n:
                status, x = "MaxIterations", factors.solve(right[None])[0]
                for _ in range(most):
                    z = factors.solve(residual(m, x, right)[None])[0]
                    x = x + z
                    if (z * z).sum() <= eps * eps * (x * x).sum():
                        status = "Converged"
                        break
        return pa.table({"sys": pa.array([name] * n, pa.int64()), "i": pa.array(np.arange(n)), "v": pa.array(x, mask=np.full(n, status == "Failed")), "status": pa.array([status] * n, pa.string())})

    return run
