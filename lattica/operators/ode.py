"""Initial-value problems y' = f(t, y): each row's trajectory is a fold over the steps.

``f`` maps columns (t, y) to a column; a trajectory has trunc(t_end / dt) + 1 states, the first included.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import roots, small

Field = Callable[[Column, Column], Column]
Step = Callable[[Column, Column, Column], Column]


def euler_step(f: Field) -> Step:
    return lambda t, y, dt: y + dt * f(t, y)


def heun_step(f: Field) -> Step:
    def step(t, y, dt):
        first = f(t, y)
        return y + dt * (first + f(t + dt, y + dt * first)) / 2

    return step


def runge_kutta_step(f: Field) -> Step:
    def step(t, y, dt):
        k1 = f(t, y)
        k2 = f(t + dt / 2, y + dt / 2 * k1)
        k3 = f(t + dt / 2, y + dt / 2 * k2)
        return y + dt * (k1 + 2 * k2 + 2 * k3 + f(t + dt, y + dt * k3)) / 6

    return step


def implicit_euler_step(f: Field, df: Field, eps: float = 1e-8, most: int = 100) -> Step:
    """x - y - dt f(t + dt, x) = 0 by Newton's method from y; NaN where it doesn't converge.

    A fold can't end early, so the moves are folds in a fold: once x is found, a block of moves costs one look.
    """
    block = max(1, math.isqrt(most))

    def step(t, y, dt):
        gap = lambda x: x - y - dt * f(t + dt, x)
        move = lambda x, _: F.when(F.abs(gap(x)) <= eps, x).otherwise(x - F.try_divide(gap(x), 1 - dt * df(t + dt, x)))
        moves = lambda x, k: F.when(F.abs(gap(x)) <= eps, x).otherwise(F.aggregate(F.sequence(k, F.least(k + (block - 1), F.lit(most))), x, move))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(most), F.lit(block)), y, moves)
        return small.let(found, lambda x: F.when(F.abs(gap(x)) <= eps, x).otherwise(F.lit(float("nan"))))

    return step


def trajectory(step: Step, y0: Column, dt: Column, t_end: Column) -> Column:
    """array<double> of the states; with t_end < dt only the first."""
    steps = F.floor(t_end / dt).cast("int")
    numbers = F.when(steps >= 1, F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    start = F.struct(y0.cast("double").alias("y"), F.array(y0.cast("double")).alias("all"))

    def fold(s: Column, k: Column) -> Column:
        return small.let(step(k.cast("double") * dt, s["y"], dt), lambda y: F.struct(y.alias("y"), F.concat(s["all"], F.array(y)).alias("all")))

    return F.aggregate(numbers, start, fold)["all"]


def solve(problems: DataFrame, keys: list[str], step: Step, y0: Column, dt: Column, t_end: Column) -> DataFrame:
    """(keys, step, t, y, status): a row a state; a state that isn't a number, and those after it, are left out."""
    states = problems.select(*keys, dt.cast("double").alias("_dt"), F.posexplode(trajectory(step, y0, dt, t_end)).alias("step", "y"))
    return states.where(~F.isnan("y")).select(*keys, "step", (F.col("step") * F.col("_dt")).alias("t"), "y")


def status(problems: DataFrame, keys: list[str], step: Step, y0: Column, dt: Column, t_end: Column) -> DataFrame:
    """(keys, status): Converged if every step did."""
    bad = F.exists(trajectory(step, y0, dt, t_end), F.isnan)
    return problems.select(*keys, F.when(bad, "MaxIterations").otherwise("Converged").alias("status"))


# Systems: the state is an array column; the field maps (t, its entries) to as many columns, the Jacobian to rows of them.
System = Callable[[Column, list[Column]], list[Column]]
SystemJacobian = Callable[[Column, list[Column]], list[list[Column]]]


def _slopes(f: System, d: int) -> Field:
    return lambda t, y: F.array(*[v.cast("double") for v in f(t, [y[i] for i in range(d)])])


def euler_system(f: System, d: int) -> Step:
    slopes = _slopes(f, d)
    return lambda t, y, dt: small.axpy(dt, slopes(t, y), y)


def heun_system(f: System, d: int) -> Step:
    slopes = _slopes(f, d)

    def step(t, y, dt):
        return small.let(slopes(t, y), lambda k: small.let(small.axpy(dt, k, y), lambda z: small.axpy(dt / 2, small.axpy(1.0, k, slopes(t + dt, z)), y)))

    return step


def runge_kutta_system(f: System, d: int) -> Step:
    slopes = _slopes(f, d)
    at = lambda t, y, c, k, then: small.let(small.axpy(c, k, y), lambda z: small.let(slopes(t + c, z), then))

    def step(t, y, dt):
        total = lambda k1, k2, k3, k4: small.axpy(dt / 6, small.axpy(1.0, k1, small.axpy(2.0, k2, small.axpy(2.0, k3, k4))), y)
        return small.let(slopes(t, y), lambda k1: at(t, y, dt / 2, k1, lambda k2: at(t, y, dt / 2, k2, lambda k3: at(t, y, dt, k3, lambda k4: total(k1, k2, k3, k4)))))

    return step


def implicit_euler_system(f: System, df: SystemJacobian, d: int, eps: float = 1e-8, most: int = 100) -> Step:
    """Newton's method from y in every step; a state that it doesn't find is null."""

    def step(t, y, dt):
        gap = lambda x: [x[i] - y[i] - dt * v for i, v in enumerate(f(t + dt, x))]
        slope = lambda x: [[(1.0 if i == j else 0.0) - dt * v for j, v in enumerate(row)] for i, row in enumerate(df(t + dt, x))]
        found = roots.newton_system(gap, slope, y, d, eps, most)
        return small.let(found, lambda o: F.when(o["status"] == "Converged", o["result"]))

    return step


def solve_system(problems: DataFrame, keys: list[str], step: Step, y0: Column, dt: Column, t_end: Column) -> DataFrame:
    """(keys, step, t, y): a row a state of a system; a state that is null, and those after it, are left out."""
    steps = F.floor(t_end / dt).cast("int")
    start = F.struct(y0.cast("array<double>").alias("y"), F.array(y0.cast("array<double>")).alias("all"))

    def fold(s: Column, k: Column) -> Column:
        new = F.when(s["y"].isNotNull(), step(k.cast("double") * dt, s["y"], dt))
        return small.let(new, lambda y: F.struct(y.alias("y"), F.concat(s["all"], F.array(y)).alias("all")))

    states = F.aggregate(small.places(steps), start, fold)["all"]
    found = problems.select(*keys, dt.cast("double").alias("_dt"), F.posexplode(states).alias("step", "y"))
    return found.where("y IS NOT NULL").select(*keys, "step", (F.col("step") * F.col("_dt")).alias("t"), "y")
