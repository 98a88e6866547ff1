"""Small dense systems in the row: matrices are array<array<double>> columns, row by row, and every method is a fold.

All of it is Catalyst expressions, so many systems are solved side by side without a shuffle and
without Python.  Systems beyond some dozens of unknowns, and sparse ones, belong to ``linear``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.operators.status import outcome

TINY = 1e-16
Body = Callable[[Column], Column]


def let(value: Column, body: Body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _state(**parts: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def places(n: Column, first: Column | int = 0) -> Column:
    """first, ..., n - 1; empty if there are none."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(n > first, F.sequence(first, F.greatest(n - 1, first))).otherwise(F.array().cast("array<int>"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def axpy(c: Column | float, x: Column, y: Column) -> Column:
    """c x + y."""
    return F.zip_with(x, y, lambda a, b: c * a + b)


def matvec(a: Column, x: Column) -> Column:
    return F.transform(a, lambda row: dot(row, x))


def vecmat(x: Column, a: Column) -> Column:
    """The rows of ``a`` added up, each times its entry of ``x``."""
    pairs = F.zip_with(x, a, lambda c, row: _state(c=c, row=row))
    zero = F.transform(F.get(a, F.lit(0)), lambda _: F.lit(0.0))
    return F.aggregate(pairs, zero, lambda s, p: F.zip_with(s, p["row"], lambda t, v: t + p["c"] * v))


def matmul(a: Column, b: Column) -> Column:
    return F.transform(a, lambda row: vecmat(row, b))


def identity(n: Column) -> Column:
    return F.transform(places(n), lambda i: F.transform(places(n), lambda j: F.when(i == j, 1.0).otherwise(0.0)))


def is_zero(x: Column) -> Column:
    return F.forall(x, lambda v: v == 0)


def lu(a: Column, pivot: bool = True) -> Column:
    """struct(m, order, ok): rows of ``a`` in this order are L U, where ``m`` holds U and, below it, the multipliers of L.

    Without ``pivot`` the rows stay as they are.  A pivot below TINY ends it: ``ok`` is false.
    """
    n = F.size(a)

    def step(s: Column, k: Column) -> Column:
        m = s["m"]
        tall = F.array_max(F.transform(places(n, k), lambda i: _state(v=F.abs(m[i][k]), i=-i)))["i"]

        def eliminate(p: Column) -> Column:
            swap = lambda x: F.transform(x, lambda row, i: F.when(i == k, x[p]).when(i == p, x[k]).otherwise(row))

            def reduce(t: Column) -> Column:
                top, value = t["m"][k], t["m"][k][k]
                fine = F.abs(value) >= TINY
                below = lambda row: let(F.try_divide(row[k], value), lambda f: F.transform(row, lambda v, j: F.when(j < k, v).when(j == k, f).otherwise(v - f * top[j])))
                return _state(m=F.transform(t["m"], lambda row, i: F.when((i > k) & fine, below(row)).otherwise(row)), order=t["order"], ok=s["ok"] & fine)

            return let(_state(m=swap(m), order=swap(s["order"])), reduce)

        return F.when(s["ok"], let(-tall if pivot else k, eliminate)).otherwise(s)

    return F.aggregate(places(n), _state(m=a, order=places(n), ok=F.lit(True)), step)


def forward(m: Column, b: Column) -> Column:
    """x of L x = b, where L has ones on its diagonal and the part of ``m`` below it."""
    below = lambda b: F.aggregate(places(F.size(b)), F.array().cast("array<double>"), lambda x, i: F.concat(x, F.array(b[i] - dot(F.slice(m[i], F.lit(1), i), x))))
    return let(b, below)


def backward(m: Column, b: Column) -> Column:
    """x of U x = b, where U is the upper part of ``m``; entries that a zero on the diagonal leaves open are null."""

    def above(b: Column) -> Column:
        n = F.size(b)

        def step(x: Column, k: Column) -> Column:
            i = n - 1 - k
            return F.concat(F.array(F.try_divide(b[i] - dot(F.slice(m[i], i + 2, k), x), F.when(F.abs(m[i][i]) >= TINY, m[i][i]))), x)

        return F.aggregate(places(n), F.array().cast("array<double>"), step)

    return let(b, above)


def lu_solve(factors: Column, b: Column) -> Column:
    """x of a x = b from the factors; null if they aren't ok."""
    ordered = lambda b: F.transform(factors["order"], lambda i: b[i])
    return F.when(factors["ok"], backward(factors["m"], forward(factors["m"], let(b, ordered))))


def residual(a: Column, x: Column, b: Column) -> Column:
    """b - a x as if computed in twice the precision and then rounded.

    Sums and products carry what rounding lost: products by halves of 26 bits.  The terms are written
    out, since every binding costs the analyser several passes.
    """

    def halves(v: Column) -> tuple[Column, Column]:
        c = v * 134217729.0  # 2**27 + 1
        return c - (c - v), v - (c - (c - v))

    def add(s: Column, p: Column) -> Column:
        product = p["a"] * p["x"]
        (ah, al), (bh, bl) = halves(p["a"]), halves(p["x"])
        lost = ((ah * bh - product) + ah * bl + al * bh) + al * bl
        total = s["v"] - product
        moved = total - s["v"]
        return _state(v=total, e=s["e"] + ((s["v"] - (total - moved)) + (-product - moved)) - lost)

    def row(entries: Column, start: Column) -> Column:
        return F.aggregate(F.zip_with(entries, x, lambda c, v: _state(a=c, x=v)), _state(v=start, e=F.lit(0.0)), add, lambda s: s["v"] + s["e"])

    return F.zip_with(a, b, row)


def solve(a: Column, b: Column, eps: float = 1e-12, most: int = 50) -> Column:
    """x of a x = b by LU and refinement until a correction is small against x; null if ``a`` is singular."""

    def refine(f: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            better = lambda z: let(axpy(F.lit(1.0), z, s["x"]), lambda x: _state(x=x, done=(norm(z) <= eps * norm(x)) | is_zero(x)))
            return F.when(s["done"], s).otherwise(let(lu_solve(f, residual(a, s["x"], b)), better))

        start = _state(x=lu_solve(f, b), done=F.lit(False))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["x"]
        return F.when(f["ok"], found)

    return let(lu(a), refine)


def qr(a: Column) -> Column:
    """struct(q, r) by Householder reflections; a zero column is left alone."""
    n = F.size(a)

    def step(s: Column, k: Column) -> Column:
        r = s["r"]
        column = F.transform(r, lambda row, i: F.when(i < k, 0.0).otherwise(row[k]))
        reflected = let(norm(column), lambda size: F.transform(column, lambda v, i: v + F.when(i == k, F.when(v < 0, -size).otherwise(size)).otherwise(0.0)))

        def reflect(v: Column) -> Column:
            mirrored = let(vecmat(v, r), lambda w: F.zip_with(r, v, lambda row, c: axpy(-2 * c, w, row)))
            turned = F.transform(s["q"], lambda row: let(dot(row, v), lambda d: axpy(-2 * d, v, row)))
            return _state(q=turned, r=mirrored)

        return let(reflected, lambda v: let(norm(v), lambda size: F.when(size == 0, s).otherwise(let(F.transform(v, lambda c: c / size), reflect))))

    found = F.aggregate(places(n - 1), _state(q=identity(n), r=a), step)
    upper = lambda r: F.transform(r, lambda row, i: F.transform(row, lambda v, j: F.when(j < i, 0.0).otherwise(v)))
    return let(found, lambda s: _state(q=s["q"], r=upper(s["r"])))


def qr_solve(factors: Column, b: Column) -> Column:
    return backward(factors["r"], vecmat(b, factors["q"]))  # bound in ``backward``, so it is made once


def qr_eigenvalues(a: Column, sweeps: int) -> Column:
    """The diagonal after unshifted QR sweeps: the eigenvalues if they are real and of different size."""
    turned = F.aggregate(F.sequence(F.lit(1), F.lit(sweeps)), a, lambda t, _: let(qr(t), lambda f: matmul(f["r"], f["q"]))) if sweeps else a
    return F.transform(turned, lambda row, i: row[i])


def symmetric_eigenvalues(a: Column, sweeps: int) -> Column:
    """The eigenvalues of a symmetric matrix by Jacobi's rotations, as they stand on the diagonal in the end.

    A sweep is a tournament in which every two unknowns meet once; the pairs of a round are disjoint, so a round turns all of them in one pass over the matrix.  Ten sweeps are enough for
    some dozens of unknowns.
    """

    def rounds(a: Column, r: Column) -> Column:
        n = F.size(a)
        top = n + n % 2 - 1  # an odd number gets a player who isn't there
        turns = r % F.greatest(top, F.lit(1))

        def partner(i: Column) -> Column:
            other = F.when(i == top, turns).otherwise(F.pmod(2 * turns - i, F.greatest(top, F.lit(1))))
            other = F.when(other == i, top).otherwise(other)
            return F.when(other < n, other).otherwise(i)

        def turn(i: Column, j: Column) -> Column:
            p, q = F.least(i, j), F.greatest(i, j)
            still = (i == j) | (a[p][q] == 0)
            tau = F.try_divide(a[q][q] - a[p][p], 2 * a[p][q])
            t = F.when(still, 0.0).otherwise(F.when(tau < 0, -1.0).otherwise(1.0) / (F.abs(tau) + F.sqrt(1 + tau * tau)))
            return let(t, lambda t: _state(j=j, c=1 / F.sqrt(1 + t * t), s=F.when(i == p, -t).otherwise(t) / F.sqrt(1 + t * t)))

        def move(c: Column) -> Column:
            rows = F.transform(a, lambda row, i: F.zip_with(row, a[c[i]["j"]], lambda u, v: c[i]["c"] * u + c[i]["s"] * v))
            return F.transform(rows, lambda row: F.transform(row, lambda u, j: c[j]["c"] * u + c[j]["s"] * row[c[j]["j"]]))

        return let(F.transform(places(n), lambda i: let(partner(i), lambda j: turn(i, j))), move)

    count = sweeps * F.greatest(F.size(a) + F.size(a) % 2 - 1, F.lit(1))
    return let(F.aggregate(F.sequence(F.lit(0), count - 1), a, rounds), lambda turned: F.transform(turned, lambda row, i: row[i]))


def iterate(first: Column, eps: float, most: int, step: Body) -> Column:
    """struct(status, result, iterations) of a fold whose state has ``x`` and the residual's norm ``gap``; a null gap fails."""
    nan = F.lit(float("nan"))

    def move(s: Column, _: Column) -> Column:
        going = (s["gap"] > eps) & ~F.isnan(s["gap"])
        return F.when(going, let(step(s["s"]), lambda t: _state(s=t, gap=F.coalesce(t["gap"], nan), n=s["n"] + 1))).otherwise(s)

    start = let(first, lambda s: _state(s=s, gap=F.coalesce(s["gap"], nan), n=F.lit(0)))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, move) if most else start
    return let(found, lambda s: outcome(s["gap"], eps, s["s"]["x"], s["n"]))


def sor(a: Column, b: Column, x0: Column, eps: float, most: int, omega: float = 1.0) -> Column:
    """struct(status, result, iterations) of successive over-relaxation, of Gauss and Seidel's method with ``omega`` 1."""
    if not 0 < omega < 2:
        raise ValueError("omega has to lie between 0 and 2")
    gap = lambda x: norm(F.zip_with(matvec(a, x), b, lambda u, v: v - u))

    def step(s: Column) -> Column:
        def relax(x: Column, i: Column) -> Column:
            move = omega * F.try_divide(b[i] - dot(a[i], x), a[i][i])
            return let(move, lambda m: F.transform(x, lambda v, j: F.when(j == i, v + m).otherwise(v)))

        return let(F.aggregate(places(F.size(b)), s["x"], relax), lambda x: _state(x=x, gap=gap(x)))

    return iterate(_state(x=x0, gap=gap(x0)), eps, most, step)


def descend(a: Column, b: Column, x0: Column, eps: float, most: int, conjugate: bool) -> Column:
    """struct(status, result, iterations) of steepest descent or conjugate gradients (Fletcher and Reeves), for positive definite matrices."""

    def step(s: Column) -> Column:
        def along(z: Column) -> Column:
            def move(alpha: Column) -> Column:
                r = axpy(-alpha, z, s["r"])

                def turn(r: Column) -> Column:
                    size = dot(r, r)
                    direction = axpy(F.try_divide(size, s["gap"] * s["gap"]), s["p"], r) if conjugate else r
                    return _state(x=axpy(alpha, s["p"], s["x"]), r=r, p=direction, gap=F.sqrt(size))

                return let(r, turn)

            return let(F.try_divide(s["gap"] * s["gap"], dot(s["p"], z)), move)

        return let(matvec(a, s["p"]), along)

    start = let(F.zip_with(matvec(a, x0), b, lambda u, v: v - u), lambda r: _state(x=x0, r=r, p=r, gap=norm(r)))
    return iterate(start, eps, most, step)


def inverse_iteration(a: Column, x0: Column, shift: float, eps: float, most: int) -> Column:
    """struct(status, result: struct(value, vector), iterations) of the eigenvalue next to ``shift``, with one factorisation.

    A zero start is replaced by 0.1 everywhere; a singular ``a - shift`` fails.
    """
    moved = F.transform(a, lambda row, i: F.transform(row, lambda v, j: F.when(i == j, v - shift).otherwise(v)))
    unit = lambda x: let(norm(x), lambda size: F.transform(x, lambda v: F.try_divide(v, size)))

    def judge(z: Column) -> Column:
        ratio = lambda w: let(dot(z, w), lambda value: _state(x=_state(value=value, vector=z), gap=F.try_divide(3 * norm(axpy(-value, z, w)), F.abs(value))))
        return let(matvec(a, z), ratio)

    def run(f: Column) -> Column:
        begin = unit(F.when(is_zero(x0), F.transform(x0, lambda _: F.lit(0.1))).otherwise(x0))
        first = _state(x=_state(value=F.lit(0.0), vector=begin), gap=F.when(f["ok"], F.lit(float("inf"))))
        return iterate(first, abs(eps), most, lambda s: let(unit(lu_solve(f, s["x"]["vector"])), judge))

    return let(lu(moved), run)
