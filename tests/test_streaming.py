"""Streams that arrive in several batches end in the state of the whole."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import interpolants, keyed
from lattica.streaming import state

WRITES = [[(0, 1, 5.0), (1, 2, 7.0), (2, 1, 6.0)], [(3, 1, 1.0), (4, 3, 9.0)], [(5, 2, 2.0), (6, 1, 8.0), (7, 1, 0.5)]]
SCHEMA = "seq long, key long, value double"


def feed(spark, tmp_path, make, name, mode):
    """Run the stream over one file a batch; all rows it gave, and those of the last batch a key."""
    folder = tmp_path / "in"
    folder.mkdir()
    query = None
    for k, rows in enumerate(WRITES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        if query is None:
            query = make(spark.readStream.schema(SCHEMA).parquet(f"file://{folder}")).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/state").start()
        query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_upsert(spark, tmp_path):
    got = feed(spark, tmp_path, lambda s: state.upsert_stream(s, "key", "value", "seq"), "upserted", "complete")
    want = keyed.build(spark.createDataFrame([r for b in WRITES for r in b], SCHEMA), "key", "value", "seq")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, 0.5), (2, 2.0), (3, 9.0)]


def test_first_edges(spark, tmp_path):
    make = lambda s: state.first_edges_stream(s.selectExpr("key AS src", "key AS dst", "value AS weight", "seq"), "seq")
    assert sorted(map(tuple, feed(spark, tmp_path, make, "edges_so_far", "complete").collect())) == [(1, 1, 5.0), (2, 2, 7.0), (3, 3, 9.0)]


def test_heap(spark, tmp_path):
    got = feed(spark, tmp_path, lambda s: state.heap_stream(s, "key", "value", "seq", 2), "heap_so_far", "update").collect()
    last = {}
    for r in got:
        last[r["key"], r["ord"]] = (r["priority"], r["tiebreak"])
    assert last == {(1, 0): (0.5, 7), (1, 1): (1.0, 3), (2, 0): (2.0, 5), (2, 1): (7.0, 1), (3, 0): (9.0, 4)}


def test_heap_keeps_equal_rows(spark, tmp_path):
    got = feed(spark, tmp_path, lambda s: state.heap_stream(s.selectExpr("1L AS key", "1.0D AS value", "7L AS seq"), "key", "value", "seq", 5), "equal_rows", "update").collect()
    assert max(r["ord"] for r in got) == 4


def test_windowed_integral(spark, tmp_path):
    make = lambda s: state.windowed_integral(s.selectExpr("timestamp_seconds(seq * 4) AS ts", "key", "value"), "ts", "key", "value", "10 seconds", "1 second")
    got = feed(spark, tmp_path, make, "integrals", "append").collect()
    assert {(r["key"], r["window"]["start"].second): r["integral"] for r in got if r["key"] == 1 and r["window"]["start"].second == 0} == {(1, 0): 44.0}


# Changes of keys (or of edges), out of order: a removal before the write that it follows, one that comes late, and one in between.
CHANGES = [[(5, 1, 9.0, None), (3, 1, None, True), (0, 2, 7.0, False)], [(1, 1, 5.0, None), (4, 2, None, True), (2, 3, 1.0, None)], [(6, 3, 2.0, False), (7, 1, None, True), (8, 1, 4.0, None), (9, 1, 3.0, None)]]
CHANGED = "seq long, key long, value double, gone boolean"


def changed(spark, tmp_path, make):
    """The last row of each key of a stream that is stopped and started again from its checkpoint before each batch."""
    folder, last = tmp_path / "in", {}
    folder.mkdir()

    def note(batch, _):
        for r in batch.collect():
            last[r[0]] = tuple(r[1:])

    for rows in CHANGES:
        spark.createDataFrame(rows, CHANGED).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        query = make(spark.readStream.schema(CHANGED).parquet(f"file://{folder}")).writeStream.outputMode("update").foreachBatch(note).option("checkpointLocation", f"file://{tmp_path}/state").start()
        query.processAllAvailable()
        query.stop()
    return last


def test_map_with_removals_over_restarts(spark, tmp_path):
    got = changed(spark, tmp_path, lambda s: state.map_stream(s, "key", "value", "seq", "gone"))
    every = spark.createDataFrame([r for b in CHANGES for r in b], CHANGED)
    writes = keyed.build(every.where("gone IS NOT TRUE"), "key", "value", "seq")
    late = every.groupBy("key").agg({"seq": "max"}).join(every, "key").where("seq = `max(seq)` AND gone").select("key")
    want = {r["key"]: r["value"] for r in keyed.remove(writes, late, "key").collect()}
    assert {k: v for k, (v, gone) in got.items() if not gone} == want == {1: 3.0, 3: 2.0} and got[2] == (None, True)


def test_edges_with_removals_over_restarts(spark, tmp_path):
    make = lambda s: state.edges_stream(s.selectExpr("key AS src", "key AS dst", "value AS weight", "seq", "gone"), "seq", "gone")
    got = {k: w for k, (_, w) in changed(spark, tmp_path, make).items()}
    # Of 1 the first insertion after the removal at 7; 2 is gone; 3 was never removed, so its first weight stays.
    assert got == {1: 4.0, 2: None, 3: 1.0}


def test_interpolants_over_restarts(spark, tmp_path):
    # Places come out of order, over three batches and restarts; nulls are no nodes.
    got = changed(spark, tmp_path, lambda s: state.interpolants_stream(s, "key", "seq", "value"))
    rows = [(s, k, v) for b in CHANGES for s, k, v, _ in b]
    want = interpolants.build(spark.createDataFrame(rows, "seq long, key long, value double"), ["key"], "seq", "value")
    values = lambda df: {r["key"]: [r["a"], r["b"]] for r in df.select("key", *[f(F.col("interpolant"), F.lit(4.5)).alias(n) for f, n in ((interpolants.barycentric_value, "a"), (interpolants.newton_value, "b"))]).collect()}
    mine = spark.createDataFrame([(k, tuple(i)) for k, (i,) in got.items()], f"key long, interpolant struct<{interpolants.SCHEMA.replace(' ', ':', 1).replace(', ', ',').replace(' array', ':array')}>")
    assert sorted(map(len, (i["x"] for (i,) in got.values()))) == [1, 2, 4]
    for key, pair in values(want).items():
        assert values(mine)[key] == pytest.approx(pair, abs=1e-9) and pair[0] == pytest.approx(pair[1], abs=1e-9)
