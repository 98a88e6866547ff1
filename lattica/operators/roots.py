"""Root finding as column expressions: a fold over the iteration numbers, one row a problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.operators import small
from lattica.operators.status import outcome

Function = Callable[[Column], Column]
Fields = Callable[[list[Column]], list[Column]]
Jacobian = Callable[[list[Column]], list[list[Column]]]


def newton(f: Function, df: Function, x0: Column, eps: float, most: int) -> Column:
    """struct(status, result, iterations) of Newton's method; a zero derivative fails."""
    start = F.struct(x0.cast("double").alias("x"), F.lit(0).alias("n"))

    def step(s: Column, _: Column) -> Column:
        value = f(s["x"])
        new = F.struct((s["x"] - F.try_divide(value, df(s["x"]))).alias("x"), (s["n"] + 1).alias("n"))
        return F.when(F.abs(value) <= eps, s).otherwise(new)

    state = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step) if most else start
    return outcome(F.abs(f(state["x"])), eps, state["x"], state["n"])


def damped_newton(f: Function, df: Function, x0: Column, eps: float, most: int, least: float, first: float = 0.2) -> Column:
    """The same with damping: a trial is taken if neither the residual nor the simplified Newton step grows.

    A rejected trial halves the damping, two accepted ones in a row double it, between ``least``
    and 1; every trial is an iteration.  At the least damping the trial is taken as it is.
    """
    if least > 1:
        raise ValueError("the least damping can't be over 1")
    start = F.struct(x0.cast("double").alias("x"), F.lit(float(first)).alias("damping"), F.lit(0).alias("good"), F.lit(0).alias("n"))

    def step(s: Column, _: Column) -> Column:
        value, slope = f(s["x"]), df(s["x"])
        move = -F.try_divide(value, slope)
        trial = s["x"] + s["damping"] * move
        new = f(trial)
        fine = (F.abs(new) <= F.abs(value)) & (F.abs(F.try_divide(new, slope)) <= F.abs(move)) | (s["damping"] <= least)
        twice = s["good"] >= 1
        accepted = F.struct(
            trial.alias("x"),
            F.when(twice, F.least(F.lit(1.0), 2 * s["damping"])).otherwise(s["damping"]).alias("damping"),
            F.when(twice, 0).otherwise(s["good"] + 1).alias("good"),
            (s["n"] + 1).alias("n"),
        )
        rejected = F.struct(s["x"].alias("x"), F.greatest(F.lit(float(least)), s["damping"] / 2).alias("damping"), F.lit(0).alias("good"), (s["n"] + 1).alias("n"))
        return F.when(F.abs(value) <= eps, s).when(move.isNull(), F.struct(F.lit(float("nan")).alias("x"), s["damping"].alias("damping"), s["good"].alias("good"), s["n"].alias("n"))).when(fine, accepted).otherwise(rejected)

    state = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step) if most else start
    return outcome(F.abs(f(state["x"])), eps, state["x"], state["n"])


def _vector(f: Fields, d: int) -> Function:
    return lambda x: F.array(*[v.cast("double") for v in f([x[i] for i in range(d)])])


def _matrix(df: Jacobian, d: int) -> Function:
    return lambda x: F.array(*[F.array(*[v.cast("double") for v in row]) for row in df([x[i] for i in range(d)])])


def _solver(slopes: Function, d: int) -> Callable[[Column, Callable[[Function], Column]], Column]:
    """``then`` of a function that solves with the Jacobian at ``x``; a singular one gives null."""

    def with_solver(x: Column, then: Callable[[Function], Column]) -> Column:
        if d > 2:
            return small.let(small.lu(slopes(x)), lambda g: then(lambda b: small.lu_solve(g, b)))
        # One or two unknowns need no factors.
        inverse = lambda a: lambda b: F.when(a[0][0] != 0, F.array(b[0] / a[0][0]))
        if d == 2:
            det = lambda a: a[0][0] * a[1][1] - a[0][1] * a[1][0]
            inverse = lambda a: lambda b: F.when(det(a) != 0, F.array((b[0] * a[1][1] - b[1] * a[0][1]) / det(a), (a[0][0] * b[1] - a[1][0] * b[0]) / det(a)))
        return small.let(slopes(x), lambda a: then(inverse(a)))

    return with_solver


def newton_system(f: Fields, df: Jacobian, x0: Column, d: int, eps: float, most: int) -> Column:
    """struct(status, result, iterations) in ``d`` dimensions: ``f`` maps the unknowns to as many columns, ``df`` to rows of them.

    A singular Jacobian fails.
    """
    value, solver = _vector(f, d), _solver(_matrix(df, d), d)
    state = lambda x: F.struct(x.alias("x"), small.norm(value(x)).alias("gap"))

    def step(s: Column) -> Column:
        move = solver(s["x"], lambda solve: small.let(value(s["x"]), solve))
        return small.let(move, lambda z: small.let(small.axpy(-1.0, z, s["x"]), state))

    return small.iterate(state(x0), eps, most, step)


def damped_newton_system(f: Fields, df: Jacobian, x0: Column, d: int, eps: float, most: int, least: float, first: float = 0.2) -> Column:
    """The same with damping, as in ``damped_newton``; norms take the place of absolute values."""
    if least > 1:
        raise ValueError("the least damping can't be over 1")
    value, solver = _vector(f, d), _solver(_matrix(df, d), d)

    def state(x: Column, gap: Column, damping: Column, good: Column) -> Column:
        return F.struct(x.alias("x"), gap.alias("gap"), damping.alias("damping"), good.alias("good"))

    def step(s: Column) -> Column:
        damping = s["damping"]

        def judge(t: Column) -> Column:
            fine = (t["gap"] <= s["gap"]) & (small.norm(t["again"]) <= small.norm(t["move"])) | (damping <= least)
            twice = s["good"] >= 1
            accepted = state(t["x"], t["gap"], F.when(twice, F.least(F.lit(1.0), 2 * damping)).otherwise(damping), F.when(twice, 0).otherwise(s["good"] + 1))
            rejected = state(s["x"], s["gap"], F.greatest(F.lit(float(least)), damping / 2), F.lit(0))
            failed = state(s["x"], F.lit(float("nan")), damping, s["good"])
            return F.when(t["move"].isNull(), failed).when(fine, accepted).otherwise(rejected)

        def attempt(solve: Function) -> Column:
            def there(move: Column) -> Column:
                there_ = small.axpy(-damping, move, s["x"])
                return small.let(there_, lambda x: small.let(value(x), lambda v: F.struct(move.alias("move"), x.alias("x"), small.norm(v).alias("gap"), solve(v).alias("again"))))

            return small.let(small.let(value(s["x"]), solve), there)

        return small.let(solver(s["x"], attempt), judge)

    return small.iterate(state(x0, small.norm(value(x0)), F.lit(float(first)), F.lit(0)), eps, most, step)
