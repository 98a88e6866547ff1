"""Table functions for SQL text: recurrences along an ordered table, a group after the other.

``register(spark, "g long")`` names them for the session, for tables (g, place, value):

* ``running_integral(TABLE (SELECT g, at, v ...) PARTITION BY g ORDER BY at)``: (g, at, value, integral), the integral of the value over
  the place so far, by trapezoids.
* ``relaxation(TABLE (...) PARTITION BY g ORDER BY at, rate => 0.5, method => 'heun')``: (g, at, value, y), where y' = rate (value - y), y is the value at
  the first row, and a step (``euler``, ``heun``, or ``implicit`` Euler) leads from each row to the next.
* ``fourier_lines(TABLE (...) PARTITION BY g ORDER BY at, periods => array(24.0, 12.0))``: (g, period, n, cosine, sine), a row a period, with the sums of
  value * cos(2 pi k / period) and value * sin(2 pi k / period) over the n rows k = 0, 1, ... of the group.

The last two columns of the table are the place and the value, cast to double; the ones before are carried (by ``fourier_lines``, from the group's
first row).  Rows whose place or value is null take no part, and are returned with the result so far (null before there is one).
Spark deals and sorts the groups (null is a group), and the functions take their rows in Arrow batches with a state of a few numbers, so a group of any length
needs a batch of memory; but it is one task, in its order, as recurrences are.  Rows that tie in the order come in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

METHODS = ("euler", "heun", "implicit")


def _constant(argument: pa.Array):
    """The value of an argument that is the same for all rows."""
    found = argument[0].as_py()
    if found is None:
        raise ValueError("rate, method and periods can't be null")
    return found


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that count, their places, their values) of a batch."""
    at, v = (pc.cast(batch.column(i), pa.float64()) for i in (batch.num_columns - 2, batch.num_columns - 1))
    rows = np.flatnonzero(pc.and_(pc.is_valid(at), pc.is_valid(v)).to_numpy(zero_copy_only=False))
    return rows, *(pc.take(c, pa.array(rows)).to_numpy(zero_copy_only=False) for c in (at, v))


def _with_column(batch: pa.RecordBatch, name: str, rows: np.ndarray, values: np.ndarray, before: float | None) -> pa.Table:
    """The batch and a column more: the values at ``rows``, each carried on to the rows that don't count."""
    *carried, at, v = batch.columns
    all_values = np.r_[np.nan if before is None else before, values]
    last = np.searchsorted(rows, np.arange(batch.num_rows), side="right")
    column = pa.array(all_values[last], pa.float64(), mask=(last == 0) & (before is None))
    return pa.Table.from_arrays([*carried, pc.cast(at, pa.float64()), pc.cast(v, pa.float64()), column], names=[*batch.schema.names[:-2], "at", "value", name])


class RunningIntegral:
    def __init__(self):
        self.end: tuple[float, float] | None = None
        self.sum = None

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        rows, at, v = _numbers(batch)
        before = self.sum
        if len(rows):
            known = self.end or (at[0], v[0])
            width, height = np.diff(np.r_[known[0], at]), np.r_[known[1], v]
            sums = np.cumsum(np.r_[before or 0.0, width * (height[1:] + height[:-1]) / 2])[1:]
            self.end, self.sum = (at[-1], v[-1]), float(sums[-1])
        else:
            sums = np.zeros(0)
        yield _with_column(batch, "integral", rows, sums, before)


class Relaxation:
    def __init__(self):
        self.end: tuple[float, float, float] | None = None

    def eval(self, batch: pa.RecordBatch, rate: pa.Array, method: pa.Array) -> Iterator[pa.Table]:
        if (how := _constant(method)) not in METHODS:
            raise ValueError(f"method has to be one of {', '.join(METHODS)}")
        rows, at, v = _numbers(batch)
        before = self.end and self.end[2]
        if len(rows):
            t0, v0, y = self.end or (at[0], v[0], v[0])
            z = np.diff(np.r_[t0, at]) * float(_constant(rate))
            old = np.r_[v0, v[:-1]]
            # Each step is y <- keep y + gain, whatever the method.
            keep, gain = {
                "euler": (1 - z, z * old),
                "heun": (1 - z + z * z / 2, z * (old + v) / 2 - z * z * old / 2),
                "implicit": (1 / (1 + z), z * v / (1 + z)),
            }[how]
            found = np.empty(len(rows))
            for i, (k, g) in enumerate(zip(keep.tolist(), gain.tolist())):
                y = k * y + g
                found[i] = y
            self.end = (at[-1], v[-1], float(y))
        else:
            found = np.zeros(0)
        yield _with_column(batch, "y", rows, found, before)


class FourierLines:
    def __init__(self):
        self.first: pa.RecordBatch | None = None
        self.rows = 0

    def eval(self, batch: pa.RecordBatch, periods: pa.Array) -> Iterator[pa.Table]:
        if self.first is None and batch.num_rows:
            self.first = batch.slice(0, 1)
            self.periods = np.array([float(p) for p in _constant(periods)])
            self.sums = np.zeros(len(self.periods), complex)
        rows, _, v = _numbers(batch)
        # The place within the period is found in whole periods first, so that the angle keeps its digits.
        for i, period in enumerate(self.periods if len(rows) else ()):
            self.sums[i] += v @ np.exp(2j * np.pi * (np.mod(np.arange(self.rows, self.rows + len(rows)), period) / period))
        self.rows += len(rows)
        yield from ()

    def terminate(self) -> Iterator[pa.Table]:
        if self.first is None:
            return
        n, carried = len(self.periods), self.first.columns[:-2]
        columns = [pa.concat_arrays([c] * n) for c in carried]
        columns += [pa.array(self.periods), pa.array([self.rows] * n, pa.int64()), pa.array(self.sums.real.copy()), pa.array(self.sums.imag.copy())]
        yield pa.Table.from_arrays(columns, names=[*self.first.schema.names[:-2], "period", "n", "cosine", "sine"])


#: Name: the function and the columns it returns after the carried ones.
FUNCTIONS = {
    "running_integral": (RunningIntegral, "at double, value double, integral double"),
    "relaxation": (Relaxation, "at double, value double, y double"),
    "fourier_lines": (FourierLines, "period double, n long, cosine double, sine double"),
}


def register(spark: SparkSession, carried: str, suffix: str = "") -> None:
    """Name the functions for this session's SQL, for tables whose columns before the last two are ``carried``, as in DDL.

    Functions that take Arrow batches declare what they return, so each list of carried columns is a registration,
    told from others by ``suffix``.
    """
    for name, (handler, own) in FUNCTIONS.items():
        spark.udtf.register(name + suffix, arrow_udtf(handler, returnType=f"{carried}, {own}" if carried else own))
