"""Queries on sorting, priority queues, ordered maps, graphs and text files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators import graph, keyed, ordered
from lattica.plans.tables import keep, new_path, table
from lattica.sources import ordered_text, text

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS ord, o_orderkey, o_totalprice FROM orders")
def sort_orders(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ordered.sort_rows(rows, "o_totalprice", "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) - 1 AS ord, l_shipdate, l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def sort_lineitem(spark, sf):
    keys = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]
    return ordered.sort_rows(table(spark, sf, "lineitem").select(*keys), *keys)


@query("""SELECT user_id, event_id, value, previous FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events)
WHERE value < previous""")
def sort_violations(spark, sf):
    return ordered.unsorted_pairs(table(spark, sf, "events").select("user_id", "event_id", "value"), "value", "event_id", ["user_id"])


@query("SELECT row_number() OVER (ORDER BY value, event_id) - 1 AS ord, event_id, value FROM events ORDER BY value, event_id LIMIT 25")
def heap_pop_k(spark, sf):
    return ordered.heap_pop(table(spark, sf, "events").select("event_id", "value"), "value", "event_id", 25)


@query("SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS ord, event_id, value FROM events) WHERE ord < 3")
def heap_pop_per_user(spark, sf):
    return ordered.heap_pop(table(spark, sf, "events").select("user_id", "event_id", "value"), "value", "event_id", 3, ["user_id"])


@query("SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) AS n FROM events) WHERE n > 25")
def heap_rest_after_pop(spark, sf):
    return ordered.heap_rest(table(spark, sf, "events").select("event_id", "value"), "value", "event_id", 25)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events) WHERE n = 1")
def heap_min_per_user(spark, sf):
    return ordered.heap_peek(table(spark, sf, "events"), "event_id", "value", "event_id", ["user_id"])


@query("""SELECT row_number() OVER (ORDER BY value, id) - 1 AS ord, id, value FROM (SELECT event_id AS id, value FROM events
UNION ALL SELECT -1 - o_orderkey, o_totalprice / 1000 FROM orders) ORDER BY value, id LIMIT 40""")
def heap_insert_then_pop(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_id").alias("id"), "value")
    more = table(spark, sf, "orders").select((-1 - F.col("o_orderkey")).alias("id"), (F.col("o_totalprice") / 1000).alias("value"))
    return ordered.heap_pop(ordered.heap_insert(events, more), "value", "id", 40)


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def map_upsert(spark, sf):
    return keyed.build(table(spark, sf, "events"), "user_id", "value", "event_id")


@query("SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS old_value FROM events")
def map_insert_returns_old(spark, sf):
    return keyed.insert_returns(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "value", "event_id")


@query("SELECT DISTINCT o_custkey FROM orders")
def map_set_build(spark, sf):
    return keyed.build_set(table(spark, sf, "orders"), "o_custkey")


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def map_len(spark, sf):
    return keyed.size(keyed.build_set(table(spark, sf, "orders"), "o_custkey"))


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer")
def map_contains(spark, sf):
    asked = table(spark, sf, "customer").select("c_custkey")
    return keyed.contains(asked, table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


_STATE = "SELECT o_custkey AS c_custkey, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey"


def _state(spark, sf):
    writes = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("price"), "o_orderkey")
    return keyed.build(writes, "c_custkey", "price", "o_orderkey")


@query(f"SELECT c_custkey, price FROM customer LEFT JOIN ({_STATE}) USING (c_custkey)")
def map_get(spark, sf):
    return keyed.get(table(spark, sf, "customer").select("c_custkey"), _state(spark, sf), "c_custkey")


@query(f"SELECT o_orderkey, c_custkey, price FROM (SELECT o_orderkey, o_custkey AS c_custkey FROM orders) JOIN ({_STATE}) USING (c_custkey)")
def map_index(spark, sf):
    asked = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return keyed.get_strict(asked, _state(spark, sf), "c_custkey", "price")


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN price * 2 ELSE price END AS price FROM ({_STATE})")
def map_get_mut(spark, sf):
    return keyed.update(_state(spark, sf), "c_custkey", "price", F.col("c_custkey") % 2 == 0, F.col("price") * 2)


@query(f"SELECT c_custkey, price FROM ({_STATE}) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def map_remove(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")
    return keyed.remove(_state(spark, sf), gone, "c_custkey")


@query(f"SELECT c_custkey, price FROM ({_STATE}) WHERE c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def map_removed_values(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")
    return keyed.removed(_state(spark, sf), gone, "c_custkey")


# A bipartite graph: supplier s is node s, part p is node (number of suppliers) + p.
_SEQ = ["l_orderkey", "l_linenumber", "l_extendedprice", "weight"]
_EDGES = """SELECT src, dst, weight, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT l_suppkey AS src, l_partkey + 1 + (SELECT max(s_suppkey) FROM supplier) AS dst, l_quantity AS weight,
l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS n FROM lineitem) WHERE n = 1"""


def _rows(spark, sf):
    offset = table(spark, sf, "supplier").agg((F.max("s_suppkey") + 1).alias("offset"))
    lines = table(spark, sf, "lineitem").join(F.broadcast(offset))  # one row
    return lines.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + F.col("offset")).alias("dst"), F.col("l_quantity").alias("weight"), "l_orderkey", "l_linenumber", "l_extendedprice")


def _first_rows(spark, sf):
    first = F.min(F.struct(*_SEQ)).alias("first")
    return _rows(spark, sf).groupBy("src", "dst").agg(first).select("src", "dst", "first.*")


@query(f"SELECT src, dst, weight FROM ({_EDGES})")
def graph_edges_first_wins(spark, sf):
    return graph.build_edges(_rows(spark, sf), _SEQ)


@query(f"SELECT src, row_number() OVER (PARTITION BY src ORDER BY l_orderkey, l_linenumber, l_extendedprice, weight, dst) - 1 AS place, dst, weight FROM ({_EDGES})")
def graph_neighbors(spark, sf):
    return graph.neighbors(_first_rows(spark, sf), [*_SEQ, "dst"])


@query(f"SELECT a.src, a.dst, e.weight FROM (SELECT DISTINCT src, dst + 1 AS dst FROM ({_EDGES})) a LEFT JOIN ({_EDGES}) e ON a.src = e.src AND a.dst = e.dst")
def graph_weight(spark, sf):
    edges = graph.build_edges(_rows(spark, sf), _SEQ)
    return graph.weights(edges, edges.select("src", (F.col("dst") + 1).alias("dst")))


@query(f"SELECT src - (src > 3)::BIGINT AS src, dst - (dst > 3)::BIGINT AS dst, weight FROM ({_EDGES}) WHERE src <> 3 AND dst <> 3")
def graph_remove_node(spark, sf):
    return graph.remove_node(graph.build_edges(_rows(spark, sf), _SEQ), 3)


@query(f"SELECT src, dst, weight FROM ({_EDGES}) WHERE (src + dst) % 5 <> 0")
def graph_remove_edge(spark, sf):
    edges = graph.build_edges(_rows(spark, sf), _SEQ)
    return graph.remove_edges(edges, edges.where((F.col("src") + F.col("dst")) % 5 == 0))


@query("SELECT s_suppkey::BIGINT AS id FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + 1 + i FROM range(5) t(i)")
def graph_insert_node(spark, sf):
    return graph.insert_nodes(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id")), 5)


def _bfs_sql(start: str) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM ({_EDGES})), b AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e), o AS MATERIALIZED (SELECT {start} AS start),
w(node, depth) USING KEY (node) AS (SELECT DISTINCT dst, 1 FROM b, o WHERE src = start UNION SELECT DISTINCT b.dst, w.depth + 1 FROM w JOIN b ON b.src = w.node WHERE b.dst NOT IN (SELECT node FROM recurring.w))
SELECT node, depth::INTEGER AS depth FROM w"""


def _both_ways(spark, sf):
    edges = graph.build_edges(_rows(spark, sf), _SEQ).select("src", "dst", F.lit(0).alias("seq"))
    return edges.union(edges.select("dst", "src", "seq"))


# From the last part.
@query(_bfs_sql("(SELECT max(dst) FROM e)"))
def graph_bfs_levels(spark, sf):
    both = keep(_both_ways(spark, sf))
    return graph.breadth_first(both, both.agg(F.max("src")).first()[0], ["seq", "dst"]).select("node", "depth")


# From the second supplier.
@query(_bfs_sql("1"))
def graph_bfs_whole(spark, sf):
    return graph.breadth_first(_both_ways(spark, sf), 1, ["seq", "dst"]).select("node", "depth")


# The visiting order: by level, within it by the parent's place and then by node.
@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM ({_EDGES})), b AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
w(node, depth, ord) USING KEY (node) AS (SELECT dst, 1, row_number() OVER (ORDER BY dst) FROM (SELECT DISTINCT dst FROM b WHERE src = 1)
UNION SELECT dst, depth, row_number() OVER (ORDER BY ord, dst) FROM (SELECT b.dst, any_value(w.depth) + 1 AS depth, min(w.ord) AS ord FROM w JOIN b ON b.src = w.node WHERE b.dst NOT IN (SELECT node FROM recurring.w) GROUP BY b.dst))
SELECT row_number() OVER (ORDER BY depth, ord) - 1 AS place, node FROM w""")
def graph_bfs_order(spark, sf):
    return ordered.sort_rows(graph.breadth_first(_both_ways(spark, sf), 1, ["seq", "dst"]), "depth", "ord", ordinal="place").select("place", "node")


# Lines of odd orders are the graph at first; those of even orders are inserted one after the other.
@query(f"""WITH l AS (SELECT l_suppkey AS src, l_partkey + 1 + (SELECT max(s_suppkey) FROM supplier) AS dst, l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem),
k AS (SELECT DISTINCT src, dst FROM l WHERE l_orderkey % 2 = 1)
SELECT src, dst, l_orderkey, l_linenumber, n = 1 AND k.src IS NULL AS added FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS n FROM l WHERE l_orderkey % 2 = 0) LEFT JOIN k USING (src, dst)""")
def graph_insert_edges(spark, sf):
    rows, odd = _rows(spark, sf), F.col("l_orderkey") % 2 == 1
    suppliers, parts = table(spark, sf, "supplier"), table(spark, sf, "part")
    offset = suppliers.agg((F.max("s_suppkey") + 1).alias("offset"))
    nodes = suppliers.select(F.col("s_suppkey").cast("long").alias("id")).union(parts.join(F.broadcast(offset)).select((F.col("p_partkey") + F.col("offset")).cast("long")))
    told = graph.insert_edges(rows.where(odd), rows.where(~odd), _SEQ, nodes)
    return told.select("src", "dst", "l_orderkey", "l_linenumber", "added")


@query(f"SELECT src, dst, weight FROM ({_EDGES}) WHERE (src + dst) % 5 = 0")
def graph_removed_weights(spark, sf):
    edges = graph.build_edges(_rows(spark, sf), _SEQ)
    return graph.removed_edges(edges, edges.where((F.col("src") + F.col("dst")) % 5 == 0))


@query("""SELECT 'queue' AS what, count(*) AS n, count(*) = 0 AS empty FROM events UNION ALL SELECT 'map', count(DISTINCT o_custkey), count(*) = 0 FROM orders
UNION ALL SELECT 'nodes', count(*), count(*) = 0 FROM supplier UNION ALL SELECT 'none', count(*), count(*) = 0 FROM orders WHERE o_totalprice < 0""")
def sizes(spark, sf):
    orders = table(spark, sf, "orders")
    counted = {"queue": table(spark, sf, "events"), "map": keyed.build_set(orders, "o_custkey"), "none": orders.where("o_totalprice < 0")}
    both = [keyed.size(df).join(keyed.is_empty(df)).select(F.lit(what).alias("what"), "n", "empty") for what, df in counted.items()]
    nodes = graph.num_nodes(table(spark, sf, "supplier")).select(F.lit("nodes").alias("what"), "n", (F.col("n") == 0).alias("empty"))
    return both[0].union(both[1]).union(both[2]).union(nodes)


@query("""WITH paths AS (SELECT n_regionkey AS start, 5 + n_nationkey AS node, [n_nationkey, 4611686018427387904] AS path FROM nation
UNION ALL SELECT n_regionkey, 30 + c_custkey, [n_nationkey, c_custkey, 4611686018427387904] FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT start::BIGINT AS start, node::BIGINT AS node, row_number() OVER (PARTITION BY start ORDER BY path) - 1 AS ord FROM paths""")
def graph_dfs_postorder(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 5).cast("long").alias("dst"), F.col("n_nationkey").cast("long").alias("seq"))
    customers = table(spark, sf, "customer").select((F.col("c_nationkey") + 5).cast("long").alias("src"), (F.col("c_custkey") + 30).alias("dst"), F.col("c_custkey").alias("seq"))
    roots = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("node"))
    return graph.depth_first_forest(nations.union(customers), roots, "seq")


# A chain of all orders, each of which also has a leaf, its negative number, after its successor: as deep as the table is long.
@query("""WITH o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS n FROM orders), r AS (SELECT min(k) AS start FROM o)
SELECT start, -1 - k AS node, 2 * n AS ord FROM o, r UNION ALL SELECT start, k, 2 * n + 1 FROM o, r WHERE k <> start""")
def graph_dfs_chain(spark, sf):
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    placed = ordered.sort_rows(keys, "k", ordinal="n")
    along = placed.join(placed.select((F.col("n") - 1).alias("n"), F.col("k").alias("dst")), "n").select(F.col("k").alias("src"), "dst", F.lit(0).cast("long").alias("seq"))
    leaves = keys.select(F.col("k").alias("src"), (-1 - F.col("k")).alias("dst"), F.lit(1).cast("long").alias("seq"))
    return graph.depth_first_forest(along.union(leaves), keys.agg(F.min("k").alias("node")), "seq")


# A general graph a region: customers point at the next one of their nation and at the nation's first one.
@query("""WITH c AS (SELECT n_regionkey AS g, c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, count(*) OVER (PARTITION BY c_nationkey) AS m
FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT g, c_custkey AS node, row_number() OVER (PARTITION BY g ORDER BY c_nationkey, n DESC) - 1 AS ord FROM c""")
def graph_dfs_general(spark, sf):
    customers = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    placed = ordered.sort_rows(customers.select(F.col("n_regionkey").alias("g"), "c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", ordinal="n")
    ahead = placed.select((F.col("n") - 1).alias("n"), F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("dst"))
    along = placed.join(ahead.hint("merge"), "n").where("c_nationkey = nation").select("g", F.col("c_custkey").alias("src"), "dst", F.lit(0).cast("long").alias("seq"))
    firsts = placed.groupBy("g", "c_nationkey").agg(F.min("c_custkey").alias("dst"))
    back = placed.join(F.broadcast(firsts), ["g", "c_nationkey"]).select("g", F.col("c_custkey").alias("src"), "dst", F.lit(1).cast("long").alias("seq"))
    heads = firsts.select("g", F.lit(-1).cast("long").alias("src"), "dst", F.col("c_nationkey").cast("long").alias("seq"))
    starts = firsts.select("g").distinct().withColumn("node", F.lit(-1).cast("long"))
    return graph.depth_first(along.union(back).union(heads), starts, "g", "seq")


@query("""SELECT c_custkey::VARCHAR || ', ' || c_acctbal::VARCHAR AS line FROM customer""")
def text_roundtrip(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    folder = new_path(spark)
    text.write_pairs(rows.select("c_custkey", F.col("c_custkey").alias("v")), rows, folder, "c_custkey", "v")
    return text.read_values(spark, folder).withColumnRenamed("value", "line")


@query("""SELECT a.v || ', ' || b.v AS line FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS n, c_nationkey::VARCHAR AS v FROM customer) a
JOIN (SELECT row_number() OVER (ORDER BY s_suppkey) AS n, s_name AS v FROM supplier) b USING (n)""")
def text_zip(spark, sf):
    folder = new_path(spark)
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("at"), F.col("c_nationkey").cast("string").alias("v"))
    right = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("at"), F.col("s_name").alias("v"))
    text.write_pairs(left, right, folder, "at", "v")
    return text.read_values(spark, folder).withColumnRenamed("value", "line")


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS line, concat(o_orderkey, ', ', o_orderpriority) AS value FROM orders")
def text_ordered_lines(spark, sf):
    folder = new_path(spark)
    ordered_text.write_lines(table(spark, sf, "orders"), folder, [F.desc("o_totalprice"), "o_orderkey"], ["o_orderkey", "o_orderpriority"])
    return ordered_text.read_lines(spark, folder)


@query("""WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS line, c_name AS value FROM customer),
s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 + (SELECT count(*) FROM customer) AS line, s_name AS value FROM supplier)
SELECT * FROM c UNION ALL SELECT * FROM s""")
def text_ordered_append(spark, sf):
    folder = new_path(spark)
    ordered_text.write_lines(table(spark, sf, "customer"), folder, ["c_custkey"], ["c_name"])
    ordered_text.write_lines(table(spark, sf, "supplier"), folder, ["s_suppkey"], ["s_name"], mode="append")
    return ordered_text.read_lines(spark, folder)
