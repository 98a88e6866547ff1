"""Outcomes of iterative solvers: struct(status, result, iterations).

``status`` is Converged, MaxIterations or Failed; ``iterations`` is null unless converged, ``result`` null
if failed.  A residual that isn't a number is a failure.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def outcome(residual: Column, eps: float | Column, result: Column, iterations: Column) -> Column:
    failed = residual.isNull() | F.isnan(residual)
    done = residual <= eps
    return F.struct(
        F.when(failed, "Failed").when(done, "Converged").otherwise("MaxIterations").alias("status"),
        F.when(~failed, result).alias("result"),
        F.when(~failed & done, iterations.cast("int")).alias("iterations"),
    )


def is_converged(status: Column) -> Column:
    return status == "Converged"


def is_successful(status: Column) -> Column:
    return status.isin("Converged", "MaxIterations")


def unwrap(status: Column, result: Column) -> Column:
    """The result unless failed, which is an error."""
    return F.when(is_successful(status), result).otherwise(F.raise_error(F.lit("solver failed")))


def successful_or(status: Column, result: Column, default: Column) -> Column:
    return F.when(is_successful(status), result).otherwise(default)


def converged_or(status: Column, result: Column, default: Column) -> Column:
    return F.when(is_converged(status), result).otherwise(default)
