"""Table functions: batches, null rows and groups, empty tables, arguments that can't be."""

import math

import pytest
from pyspark.sql import functions as F

from lattica.operators import table_functions


@pytest.fixture
def series(spark):
    """Two groups, of 1000 rows and of one; rows without a place or value in between; a null group."""
    rows = spark.range(1000).select(F.lit(1).alias("g"), (F.col("id") / 10).alias("at"), F.when(F.col("id") % 10 != 3, F.sin(F.col("id") / 10)).alias("v"))
    rows = rows.union(spark.createDataFrame([(2, 5.0, 7.0), (None, 1.0, 2.0), (None, 2.0, 2.0), (3, None, 1.0)], "g int, at double, v double")).repartition(3)
    rows.createOrReplaceTempView("series")
    table_functions.register(spark, "g int")
    return {g: sorted(((r["at"], r["v"]) for r in rows.collect() if r["g"] == g and r["at"] is not None), key=lambda x: x[0]) for g in (1, 2, 3, None)}


def call(spark, text):
    return spark.sql(f"SELECT * FROM {text}").collect()


@pytest.mark.parametrize("batch", [7, 10_000])
def test_running_integral(spark, series, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    found = call(spark, "running_integral(TABLE(series) PARTITION BY g ORDER BY at)")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 1004 and [r["integral"] for r in found if r["g"] == 3] == [None]
    for g, points in series.items():
        total, last = None, None
        mine = iter([r for r in found if r["g"] == g and r["at"] is not None])
        for at, v in points:
            if v is not None:
                total, last = (total or 0.0) + (0 if last is None else (at - last[0]) * (v + last[1]) / 2), (at, v)
            r = next(mine)
            assert (r["at"], r["value"]) == (at, v) and (r["integral"] == total or math.isclose(r["integral"], total, abs_tol=1e-12))


@pytest.mark.parametrize("method, step", [
    ("euler", lambda y, h, a, b: y + h * (a - y)),
    ("heun", lambda y, h, a, b: y + h / 2 * ((a - y) + (b - (y + h * (a - y))))),
    ("implicit", lambda y, h, a, b: (y + h * b) / (1 + h)),
])
def test_relaxation(spark, series, method, step):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    found = call(spark, f"relaxation(TABLE(series) PARTITION BY g ORDER BY at, rate => 0.5D, method => '{method}')")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    mine = iter([r["y"] for r in found if r["g"] == 1])
    y, last = None, None
    for at, v in series[1]:
        if v is not None:
            y, last = v if last is None else step(y, (at - last[0]) * 0.5, last[1], v), (at, v)
        assert math.isclose(next(mine), y, abs_tol=1e-12)


def test_fourier_lines(spark, series):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    found = call(spark, "fourier_lines(TABLE(series) PARTITION BY g ORDER BY at, periods => array(62.5D, 2D))")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["g"] or 0, r["period"], r["n"]) for r in found) == [(0, 2.0, 2), (0, 62.5, 2), (1, 2.0, 900), (1, 62.5, 900), (2, 2.0, 1), (2, 62.5, 1), (3, 2.0, 0), (3, 62.5, 0)]
    values = [v for _, v in series[1] if v is not None]
    for r in found:
        if r["g"] == 1:
            assert math.isclose(r["cosine"], sum(v * math.cos(2 * math.pi * k / r["period"]) for k, v in enumerate(values)), abs_tol=1e-8)
            assert math.isclose(r["sine"], sum(v * math.sin(2 * math.pi * k / r["period"]) for k, v in enumerate(values)), abs_tol=1e-8)


def test_empty_tables_and_bad_arguments(spark, series):
    for text in ("running_integral({})", "relaxation({}, rate => 1D, method => 'euler')", "fourier_lines({}, periods => array(2D))"):
        assert call(spark, text.format("TABLE(SELECT * FROM series WHERE g > 5) PARTITION BY g ORDER BY at")) == []
    with pytest.raises(Exception, match="method has to be one of"):
        call(spark, "relaxation(TABLE(series) PARTITION BY g ORDER BY at, rate => 1D, method => 'other')")
    with pytest.raises(Exception, match="can't be null"):
        call(spark, "relaxation(TABLE(series) PARTITION BY g ORDER BY at, rate => CAST(NULL AS DOUBLE), method => 'euler')")
