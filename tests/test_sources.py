"""The ordered text source: order, ranges of lines, appends, and what failed jobs leave."""

import os

import pytest
from pyspark.sql import functions as F

from lattica.sources import ordered_text


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/lines"


def lines(spark, folder, **range_):
    return [(r["line"], r["value"]) for r in ordered_text.read_lines(spark, folder, **range_).collect()]


def files(folder):
    return sorted(os.listdir(folder.removeprefix("file://")))


def test_lines_keep_order_in_many_parts_and_stretches(spark, folder):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(30_000).select(F.xxhash64("id").alias("h"), "id").repartition(7)
    ordered_text.write_lines(df, folder, ["h"], ["h", "id"], split=20_000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [f"{r['h']}, {r['id']}" for r in df.orderBy("h").collect()]
    found = ordered_text.read_lines(spark, folder)
    assert found.rdd.getNumPartitions() > len(files(folder)) - 1 > 1
    assert [(r["line"], r["value"]) for r in found.collect()] == list(enumerate(want))
    some = ordered_text.read_lines(spark, folder, first=12_345, last=12_347)
    assert some.rdd.getNumPartitions() == 1 and [r["value"] for r in some.collect()] == want[12_345:12_348]
    assert lines(spark, folder, first=29_999) == [(29_999, want[-1])] and lines(spark, folder, first=30_000) == []
    assert spark.read.text(folder).count() == 30_000


def test_append_and_overwrite(spark, folder):
    ordered_text.write_lines(spark.range(3), folder, ["id"], ["id"])
    ordered_text.write_lines(spark.range(5, 7), folder, [F.desc("id")], ["id"], mode="append")
    assert lines(spark, folder) == list(enumerate("01265"))
    ordered_text.write_lines(spark.range(1), folder, ["id"], ["id"])
    assert lines(spark, folder) == [(0, "0")] and len(files(folder)) == 2


def test_nulls_empty_texts_ties_and_empty_tables(spark, folder):
    rows = spark.createDataFrame([(1, None, "é, ü"), (1, "", None), (2, "x" * 9_000_000, "")], "at int, a string, b string")
    ordered_text.write_lines(rows, folder, ["at", F.desc_nulls_last("b")], ["a", "b"])
    assert lines(spark, folder) == [(0, ", é, ü"), (1, ", "), (2, "x" * 9_000_000 + ", ")]
    ordered_text.write_lines(rows.where("at > 2"), folder, ["at"], ["a"])
    assert lines(spark, folder) == [] and files(folder) == [ordered_text.MANIFEST]


def test_failed_job_leaves_nothing_and_keeps_the_old_lines(spark, folder):
    ordered_text.write_lines(spark.range(2), folder, ["id"], ["id"])
    before = files(folder)
    bad = spark.range(20_000).repartition(4).select("id", F.when(F.col("id") == 19_000, "a\nb").otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="line break"):
        ordered_text.write_lines(bad, folder, ["id"], ["v"])
    assert files(folder) == before and lines(spark, folder) == [(0, "0"), (1, "1")]


def test_missing_folder(spark, folder):
    with pytest.raises(Exception, match="_lines.json"):
        lines(spark, folder)
