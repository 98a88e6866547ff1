"""Sorting, priority queues, ordered maps and graphs on small fixtures."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lattica.operators import graph, keyed, ordered
from lattica.plans import q_tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def pairs(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pos long, v int")


# The arrays, the tree and the five edges of this file are those that the operators are compared on.
@pytest.mark.parametrize("values", [[12, 10, 24, 16, 36, 23, 15, 35], [], [1], [2, 1], [3, 3, 1, 3], list(range(9, -1, -1))])
def test_sort_is_a_permutation_in_order(spark, values):
    found = ordered.sort_rows(pairs(spark, values).repartition(3), "v", "pos")
    assert [(r["ord"], r["v"], r["pos"]) for r in found.orderBy("ord").collect()] == [(i, v, p) for i, (v, p) in enumerate(sorted((v, p) for p, v in enumerate(values)))]
    assert ordered.unsorted_pairs(found.withColumn("g", F.lit(1)), "v", "ord", ["g"]).count() == 0


def test_unsorted_pairs(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 4), (1, 2, 6)], "g int, at int, v int")
    assert [r["v"] for r in ordered.unsorted_pairs(df, "v", "at", ["g"]).collect()] == [4]


def test_heap(spark):
    df = spark.createDataFrame([(i, v, v) for i, v in enumerate([15, 20, 9, 1, 11, 8, 4, 13])], "seq long, value int, priority int")
    assert [r["value"] for r in ordered.heap_pop(df, "priority", "seq", 3).orderBy("ord").collect()] == [1, 4, 8]
    assert ordered.heap_pop(df, "priority", "seq", 99).count() == 8
    assert sorted(r["value"] for r in ordered.heap_rest(df, "priority", "seq", 3).collect()) == [9, 11, 13, 15, 20]
    assert ordered.heap_rest(df, "priority", "seq", 8).count() == 0
    more = ordered.heap_insert(df, spark.createDataFrame([(8, 0, 0)], df.schema))
    assert ordered.heap_pop(more, "priority", "seq", 1).first()["value"] == 0
    assert ordered.heap_pop(df.limit(0), "priority", "seq", 2).count() == 0
    # Value and priority may differ, and ties go by the tie-break.
    tied = spark.createDataFrame([(0, "b", 1), (1, "a", 1), (2, "c", 0)], "seq long, value string, priority int")
    assert [r["value"] for r in ordered.heap_pop(tied, -F.col("priority"), "seq", 3).orderBy("ord").collect()] == ["b", "a", "c"]
    assert rows(ordered.heap_peek(tied.withColumn("g", F.lit(7)), "value", "priority", "seq", ["g"])) == [(7, "c")]


def test_map(spark):
    writes = spark.createDataFrame([(0, 2, 20), (1, 1, 10), (2, 2, 21), (3, 4, 40)], "seq long, key int, value int")
    state = keyed.build(writes, "key", "value", "seq")
    assert rows(state, "key") == [(1, 10), (2, 21), (4, 40)]
    assert [r["old_value"] for r in keyed.insert_returns(writes, "key", "value", "seq").orderBy("seq").collect()] == [None, None, 20, None]
    asked = spark.createDataFrame([(1,), (5,)], "key int")
    assert rows(keyed.get(asked, state, "key"), "key") == [(1, 10), (5, None)]
    assert rows(keyed.contains(asked, state, "key"), "key") == [(1, True), (5, False)]
    assert rows(keyed.get_strict(asked.limit(1), state, "key", "value")) == [(1, 10)]
    with pytest.raises(PySparkException):
        keyed.get_strict(asked, state, "key", "value").collect()
    assert rows(keyed.update(state, "key", "value", F.col("key") == 2, F.col("value") + 1), "key")[1] == (2, 22)
    assert rows(keyed.remove(state, asked, "key"), "key") == [(2, 21), (4, 40)]
    assert rows(keyed.removed(state, asked, "key")) == [(1, 10)]
    assert keyed.size(keyed.build_set(writes, "key")).first()["n"] == 3


EDGES = "src long, dst long, weight long, seq long"


def test_graph_edits(spark):
    edges = spark.createDataFrame([(s, d, k, k) for k, (s, d) in enumerate([(0, 1), (0, 2), (1, 2), (3, 4), (4, 2), (0, 1)])], EDGES)
    built = graph.build_edges(edges, ["seq"])
    assert (0, 1, 0) in rows(built) and built.count() == 5
    assert rows(graph.remove_node(built, 0), "weight") == [(0, 1, 2), (2, 3, 3), (3, 1, 4)]
    assert rows(graph.remove_node(built, 2), "weight") == [(0, 1, 0), (2, 3, 3)]  # a node with edges into it
    nodes = spark.range(5).select("id")
    left, removed = graph.remove_node_from(nodes, 2)
    assert rows(left, "id") == [(0,), (1,), (2,), (3,)] and removed.first()[0]
    assert not graph.remove_node_from(nodes, 9)[1].first()[0]
    assert rows(graph.insert_nodes(nodes, 2), "id")[-1] == (6,)
    assert graph.unknown_ends(built, nodes).count() == 0 and graph.unknown_ends(built, spark.range(3)).count() == 2
    assert [r["dst"] for r in graph.neighbors(edges.where("seq < 5"), ["seq"]).where("src = 0").orderBy("place").collect()] == [1, 2]
    assert rows(graph.weights(built, spark.createDataFrame([(3, 4), (4, 3)], "src long, dst long")), "src") == [(3, 4, 3), (4, 3, None)]
    gone = spark.createDataFrame([(3, 4), (4, 3)], "src long, dst long")
    assert rows(graph.removed_edges(built, gone)) == [(3, 4, 3)]
    more = spark.createDataFrame([(0, 1, 9, 9), (2, 2, 9, 9), (2, 2, 8, 8), (4, 0, 7, 7)], EDGES)
    told = {(r["src"], r["dst"], r["seq"]): r["added"] for r in graph.insert_edges(built, more, ["seq"], nodes).collect()}
    assert told == {(0, 1, 9): False, (2, 2, 9): False, (2, 2, 8): True, (4, 0, 7): True}
    with pytest.raises(PySparkException):
        graph.insert_edges(built, more, ["seq"], spark.range(3)).collect()
    assert graph.num_nodes(nodes).first()["n"] == 5 and keyed.is_empty(nodes.limit(0)).first()["empty"]
    assert graph.remove_edges(built, spark.createDataFrame([(3, 4)], "src long, dst long")).count() == 4


TREE = [(3, 1), (3, 5), (1, 0), (1, 2), (5, 4), (5, 6)]


@pytest.mark.parametrize("extra, first", [([], [1, 5, 0, 2, 4, 6]), ([(0, 3)], [1, 5, 0, 2, 4, 6, 3])])
def test_breadth_first(spark, extra, first):
    edges = spark.createDataFrame([(s, d, 1, k) for k, (s, d) in enumerate(TREE + extra)], EDGES)
    found = graph.breadth_first(edges, 3, ["seq"]).orderBy("depth", "ord").collect()
    assert [r["node"] for r in found] == first
    assert graph.breadth_first(edges, 6, ["seq"]).count() == 0


def test_depth_first(spark):
    edges = spark.createDataFrame([(s, d, 1, k) for k, (s, d) in enumerate(TREE)], EDGES)
    found = graph.depth_first_forest(edges, spark.createDataFrame([(3,)], "node long"), "seq")
    assert [r["node"] for r in found.orderBy("ord").collect()] == [0, 2, 1, 4, 6, 5]
    starts = spark.createDataFrame([(1, 3)], "g int, node long")
    found = graph.depth_first(edges.withColumn("g", F.lit(1)), starts, "g", "seq")
    assert [r["node"] for r in found.orderBy("ord").collect()] == [0, 2, 1, 4, 6, 5]
    cyclic = edges.union(spark.createDataFrame([(0, 3, 1, 9)], EDGES)).withColumn("g", F.lit(1))
    assert 3 in [r["node"] for r in graph.depth_first(cyclic, starts, "g", "seq").collect()]


def test_depth_first_of_great_graphs_is_shared_by_tasks(spark):
    """Cycles, self-loops, repeated edges, dead ends, nodes out of reach, starts on cycles and one without edges; a chain with edges back."""
    r = np.random.default_rng(5)
    edges = [(g, int(r.integers(0, n)), int(r.integers(0, n)), int(r.integers(0, 4))) for g, n, m in ((1, 12, 40), (2, 25, 40), (3, 8, 60)) for _ in range(m)]
    edges += [(4, k, k + 1, 1) for k in range(100)] + [(4, k, 0, 0) for k in range(100)] + [(4, k + 1, k, 2) for k in range(100)] + [(5, 1, 2, 0), (6, 1, 2, 0), (6, 2, 1, 0)]
    starts = {1: 0, 2: 3, 3: 7, 4: 0, 5: 9, 6: 1}
    want = set()
    for g, start in starts.items():
        following, seen, order = {}, set(), []
        for _, s, d, _ in sorted((e for e in edges if e[0] == g), key=lambda e: (e[3], e[2])):
            following.setdefault(s, []).append(d)
        stack = [(start, iter(following.get(start, [])))]
        while stack:
            child = next((c for c in stack[-1][1] if c not in seen), None)
            if child is None:
                order.append(stack.pop()[0])
            else:
                seen.add(child)
                stack.append((child, iter(following.get(child, []))))
        want |= {(g, n, k) for k, n in enumerate(order[:-1])}
    table = spark.createDataFrame(edges, "g int, src long, dst long, seq long").repartition(3)
    roots = spark.createDataFrame(list(starts.items()), "g int, node long")
    for most in (20, 10_000):  # the first leaves graphs 5 and 6 to a task each
        found = graph.depth_first(table, roots, "g", "seq", task_edges=most).select("g", "node", "ord").collect()
        assert len(found) == len(want) and {tuple(x) for x in found} == want


def test_general_search_has_a_graph_for_each_region(spark):
    """Each graph grows with the table: the customers of a whole region, not a bounded stretch of keys."""
    found = q_tables.graph_dfs_general(spark, "/root/testdata/sf0.01")
    customers, nations = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("customer", "nation"))
    want = customers.join(nations, customers.c_nationkey == nations.n_nationkey).groupBy(F.col("n_regionkey").alias("g")).count()
    assert {tuple(x) for x in found.groupBy("g").count().collect()} == {tuple(x) for x in want.collect()}


def test_post_order_of_deep_and_wide_forests(spark):
    """A chain of 10,000 nodes, trees of random shape, a root alone, and a tree that no root reaches."""
    r = np.random.default_rng(2)
    edges = [(k, k + 1, 0) for k in range(10_000)]
    edges += [(int(r.integers(20_000, 20_000 + k)), 20_000 + k, int(r.integers(0, 3))) for k in range(1, 300)] + [(40_000, 40_001, 0)]
    table = spark.createDataFrame(edges, "src long, dst long, seq long").repartition(3)
    found = {}
    for x in graph.depth_first_forest(table, spark.createDataFrame([(0,), (20_000,), (30_000,)], "node long"), "seq").collect():
        found.setdefault(x["start"], {})[x["node"]] = x["ord"]
    kids = {}
    for s, d, q in sorted(edges, key=lambda e: (e[2], e[1])):
        kids.setdefault(s, []).append(d)
    want = {}
    for root in (0, 20_000):
        order, stack = [], [(root, iter(kids[root]))]
        while stack:
            child = next(stack[-1][1], None)
            if child is None:
                order.append(stack.pop()[0])
            else:
                stack.append((child, iter(kids.get(child, []))))
        want[root] = {n: k for k, n in enumerate(order[:-1])}
    assert found == want
    with pytest.raises(PySparkException, match="two parents"):
        graph.depth_first_forest(spark.createDataFrame([(1, 2, 0), (3, 2, 0)], "src long, dst long, seq long"), spark.createDataFrame([(1,)], "node long"), "seq").collect()


def test_breadth_first_of_the_whole_graph(spark, tmp_path):
    """A path of 12 suppliers and parts, which is deeper than eight levels, and edges of every remainder of src + dst."""
    from lattica.plans import registry

    n = 12
    lines = [(s, p) for s in range(n) for p in (s - 1, s) if p >= 0]
    spark.createDataFrame([(s,) for s in range(n)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(s, p, 1.0, k, 1, 1.0) for k, (s, p) in enumerate(lines)], "l_suppkey long, l_partkey long, l_quantity double, l_orderkey long, l_linenumber long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    following = {}
    for s, p in lines:
        following.setdefault(s, []).append(p + n)
        following.setdefault(p + n, []).append(s)
    want, level, depth = {}, [1], 0
    while level:
        depth += 1
        level = [x for x in {y for v in level for y in following[v]} if x not in want]
        want |= dict.fromkeys(level, depth)
    assert max(want.values()) > 8 and len(want) == 2 * n
    assert {r["node"]: r["depth"] for r in registry.queries()["graph_bfs_whole"](spark, str(tmp_path)).collect()} == want
