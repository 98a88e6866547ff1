"""Directed graphs as tables: ``edges(src, dst, weight, seq)`` over nodes 0, 1, 2, ..."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.ordered import sort_rows
from lattica.plans.tables import Bucketed, Kept, keep


def insert_nodes(nodes: DataFrame, count: int) -> DataFrame:
    """``count`` new nodes with the next ids."""
    top = nodes.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("next"))
    return nodes.unionByName(top.select(F.explode(F.sequence("next", F.col("next") + count - 1)).alias("id")) if count else nodes.limit(0))


def build_edges(rows: DataFrame, seq: list[str]) -> DataFrame:
    """(src, dst, weight): the first edge between two nodes keeps its weight; self-loops are allowed."""
    return rows.groupBy("src", "dst").agg(F.min_by("weight", F.struct(*seq)).alias("weight"))


def insert_edges(edges: DataFrame, rows: DataFrame, seq: list[str], nodes: DataFrame) -> DataFrame:
    """``rows`` (src, dst, weight, seq) with ``added``: whether each is the first edge between its nodes, those of ``edges`` included.

    An end that isn't a node is an error.
    """
    first = rows.groupBy("src", "dst").agg(F.min(F.struct(*seq)).alias("_first"))
    known = edges.select("src", "dst").distinct().withColumn("_known", F.lit(True))
    told = rows.join(first, ["src", "dst"]).join(known, ["src", "dst"], "left")
    for end in ("src", "dst"):
        told = told.join(nodes.select(F.col("id").alias(end)).distinct().withColumn(f"_{end}", F.lit(True)), end, "left")
    bad = F.raise_error(F.lit("an edge ends at an unknown node")).cast("boolean")
    added = F.col("_known").isNull() & (F.struct(*seq) == F.col("_first"))
    return told.select(*[F.col(c) for c in rows.columns], F.when(F.col("_src").isNull() | F.col("_dst").isNull(), bad).otherwise(added).alias("added"))


def num_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("n"))


def unknown_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that aren't nodes; has to be empty before edges are inserted."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    return ends.distinct().join(nodes, "id", "left_anti")


def neighbors(edges: DataFrame, seq: list[str]) -> DataFrame:
    """(src, place, dst, weight): each node's successors in order of insertion."""
    w = Window.partitionBy("src").orderBy(*seq)
    return edges.select("src", (F.row_number().over(w).cast("long") - 1).alias("place"), "dst", "weight")


def weights(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Each asked (src, dst) with its weight, null if there is no such edge."""
    return asked.join(edges.select("src", "dst", "weight"), ["src", "dst"], "left")


def remove_node(edges: DataFrame, node: int) -> DataFrame:
    """The edges without the node, and ids above it one less."""
    left = edges.where((F.col("src") != node) & (F.col("dst") != node))
    less = lambda c: (F.col(c) - F.when(F.col(c) > node, 1).otherwise(0)).cast("long")
    return left.withColumns({"src": less("src"), "dst": less("dst")})


def remove_node_from(nodes: DataFrame, node: int) -> tuple[DataFrame, DataFrame]:
    """(the nodes that are left, one row telling whether the node was there)."""
    left = nodes.where(F.col("id") != node).select((F.col("id") - F.when(F.col("id") > node, 1).otherwise(0)).cast("long").alias("id"))
    return left, nodes.agg(F.coalesce(F.bool_or(F.col("id") == node), F.lit(False)).alias("removed"))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def removed_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges that ``remove_edges`` takes away, with their weights."""
    return edges.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_semi")


def breadth_first(edges: DataFrame, start: int, seq: list[str], most_levels: int = 1_000_000) -> DataFrame:
    """(node, depth, ord): nodes by the least number of edges from ``start``, without the start unless it lies on a cycle.

    One level is one join of the frontier with the edges, which are bucketed by their source once,
    and one anti-join with the levels before.  Within a depth, ``ord`` (the parent's own, then the
    edge's ``seq``) gives the visiting order.
    """
    spark = edges.sparkSession
    by_source = Bucketed(edges.select("src", "dst", F.struct(*seq).alias("seq")), ["src"], edges.count())
    frontier = spark.createDataFrame([(start, 0)], "node long, ord long")
    visited = spark.createDataFrame([], "node long, depth int, ord long")
    for depth in range(1, most_levels + 1):
        found = by_source.df.join(frontier.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("ord", "seq")).alias("first"))
        new = found.join(visited.select("node"), "node", "left_anti")
        level = keep(new.orderBy("first").select("node", F.monotonically_increasing_id().alias("ord")))
        if level.isEmpty():
            break
        visited = visited.union(level.select("node", F.lit(depth).alias("depth"), "ord"))
        frontier = level
    by_source.drop()
    return visited


def depth_first_forest(edges: DataFrame, roots: DataFrame, seq: str) -> DataFrame:
    """(start, node, ord) of the nodes below each root of a forest: their post-order, children in the order of ``seq``.

    An Euler tour is a list: a node is entered, then its first child or its exit follows; a node's exit is followed by its next sibling's entry or
    its parent's exit.  Pointer jumping ranks the list, which takes a number of joins that is the logarithm of its length, however deep the forest is.
    Nodes that no root reaches don't appear; a node with two parents is an error.
    """
    children = edges.select("src", "dst", F.col(seq).alias("_seq"))
    w = Window.partitionBy("src").orderBy("_seq", "dst")
    kids = Kept(children.select("src", "dst", F.lead("dst").over(w).alias("_next"), F.row_number().over(w).alias("_n"), F.count("*").over(Window.partitionBy("dst")).alias("_parents")))
    entry, leave = lambda c: 2 * F.col(c).cast("long"), lambda c: 2 * F.col(c).cast("long") + 1
    wrong = F.raise_error(F.lit("a node has two parents")).cast("long")
    firsts = kids.df.where("_n = 1").select(entry("src").alias("id"), entry("dst").alias("next"))
    leaves = kids.df.select("dst").union(roots.select("node")).distinct().join(kids.df.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti").select(entry("dst").alias("id"), leave("dst").alias("next"))
    exits = kids.df.select(leave("dst").alias("id"), F.when(F.col("_parents") > 1, wrong).otherwise(F.coalesce(entry("_next"), leave("src"))).alias("next"))
    # A root's exit follows itself; ``w`` counts the exits from an element up to ``next``, which isn't counted.
    ends = roots.select(leave("node").alias("id"), leave("node").alias("next"))
    lists = firsts.union(leaves).union(exits).union(ends)
    now = Kept(lists.select("id", "next", F.when(F.col("id") == F.col("next"), 0).otherwise(F.col("id").bitwiseAND(F.lit(1))).cast("long").alias("w")))
    while True:
        ahead = now.df.select(F.col("id").alias("next"), F.col("next").alias("_far"), F.col("w").alias("_more"))
        then = Kept(now.df.join(ahead, "next", "left").select("id", F.coalesce("_far", "next").alias("next"), (F.col("w") + F.coalesce("_more", F.lit(0))).alias("w"), (F.col("_far") != F.col("next")).alias("_moved")))
        now.drop()
        now = then
        if now.df.where("_moved").isEmpty():
            break
    kids.drop()
    tails = now.df.join(roots.select(leave("node").alias("next"), F.col("node").alias("start")).distinct(), "next")
    total = tails.where(F.col("id") == entry("start")).select("start", F.col("w").alias("_all"))
    found = tails.where((F.col("id").bitwiseAND(F.lit(1)) == 1) & (F.col("id") != F.col("next"))).join(total, "start")
    return found.select("start", F.shiftright("id", 1).alias("node"), (F.col("_all") - F.col("w")).alias("ord"))


#: Edges of a graph that one task walks at most; greater graphs are searched by all tasks together.
TASK_EDGES = 1000


def depth_first(edges: DataFrame, starts: DataFrame, group: str, seq: str, task_edges: int = TASK_EDGES) -> DataFrame:
    """(group, node, ord): post-order from each group's start in a general graph, children in the order of ``seq`` and then of ``dst``.

    A start is given only if it lies on a cycle.  Graphs of at most ``task_edges`` edges are walked in a task each; no task holds a greater one.
    """
    # Of repeated edges only the first can be taken.
    first = edges.groupBy(group, "src", "dst").agg(F.min(seq).alias("_seq"))
    sizes = first.groupBy(group).agg((F.count("*") > task_edges).alias("_great"))
    rows = Kept(first.join(sizes, group).join(starts.select(group, F.col("node").alias("_start")), group)).df
    walked = _walked(rows.where("NOT _great"), group)
    great = rows.where("_great")
    return walked if great.isEmpty() else walked.union(_improved(great, group))


def _walked(rows: DataFrame, group: str) -> DataFrame:
    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        following = {s: list(x) for s, x in pdf.sort_values(["_seq", "dst"]).groupby("src")["dst"]}
        start = int(pdf["_start"].iloc[0])
        seen, order, stack = set(), [], [(start, iter(following.get(start, [])))]
        while stack:
            node, rest = stack[-1]
            for child in rest:
                if child not in seen:
                    seen.add(child)
                    stack.append((child, iter(following.get(child, []))))
                    break
            else:
                stack.pop()
                if stack:
                    order.append(node)
        return pd.DataFrame({group: key[0], "node": order, "ord": range(len(order))})

    kind = rows.schema[group].dataType.simpleString()
    return rows.select(group, "src", "dst", "_seq", "_start").groupBy(group).applyInPandas(walk, f"{group} {kind}, node long, ord long")


def _improved(rows: DataFrame, group: str) -> DataFrame:
    """The search as the limit of trees: every node has one edge by which it is entered, at first any of them.

    The tour of such a tree passes each edge of the nodes that the root reaches, in the order of a search; an edge that isn't the tree's is passed by.
    In a round, every node changes to the edge into it that the tour passes first.  When none changes, no edge leads to a node that would have been
    entered later, so the tour is the search.  Joins on nodes and edges are merges, since these tables are so well compressed that Spark would broadcast them
    beyond the driver's memory.  A new parent always comes before its child in the tour, so trees stay trees, and each round settles
    the search's next node at least, besides all that already agree; how many rounds it takes depends on the graph.
    """
    own = rows.where("src != dst").select(group, F.lit(False).alias("_root"), "src", "dst", "_seq")
    # The root is a copy of the start, to which no edge leads.
    root = rows.where("src = _start").select(group, F.lit(True).alias("_root"), "src", "dst", "_seq")
    placed = sort_rows(own.union(root), group, "src", "_root", F.asc_nulls_last("_seq"), "dst", ordinal="n")
    out = placed.groupBy(group, "src", "_root").agg(F.min("n").alias("_head"), F.max("n").alias("_last"))
    heads = out.where("NOT _root").select(group, F.col("src").alias("dst"), F.col("_head").alias("down"), "_last")
    # A node is named by the least of the edges that lead to it.
    nodes = Kept(placed.groupBy(group, "dst").agg(F.min("n").alias("node")).join(heads.hint("merge"), [group, "dst"], "left"))
    owners = nodes.df.select(group, F.col("dst").alias("src"), F.lit(False).alias("_root"), F.col("node").alias("up"), "_last")
    owners = owners.union(out.where("_root").select(group, "src", "_root", F.lit(None).cast("long"), "_last"))
    links = placed.join(nodes.df.drop("_last").hint("merge"), [group, "dst"]).join(owners.hint("merge"), [group, "src", "_root"])
    links = Kept(links.select(group, F.col("dst").alias("value"), "n", "node", "up", "down", (F.col("n") < F.col("_last")).alias("more"), "_seq"))
    nodes.drop()
    guess = F.struct(F.col("up").isNotNull(), F.col("_seq").isNull(), "_seq", "n")
    tree = Kept(links.df.groupBy("node").agg(F.min_by("n", guess).alias("by")))
    while True:
        into = links.df.select("n", "node", "up", "down", "more").join(tree.df.hint("merge"), "node")
        into = into.join(tree.df.select(F.col("node").alias("up"), F.col("by").alias("_up")).hint("merge"), "up", "left")
        # Element 2 n is edge n; if it is the tree's, 2 n + 1 leaves its node again.  After the last element comes null.
        on = F.when(F.col("more"), 2 * F.col("n") + 2).otherwise(2 * F.col("_up") + 1)
        edge = F.struct((2 * F.col("n")).alias("id"), F.when(F.col("n") == F.col("by"), F.coalesce(2 * F.col("down"), 2 * F.col("n") + 1)).otherwise(on).alias("next"))
        leave = F.struct((2 * F.col("n") + 1).alias("id"), on.alias("next"))
        both = into.select(F.explode(F.when(F.col("n") == F.col("by"), F.array(edge, leave)).otherwise(F.array(edge))).alias("e")).select("e.*")
        ranked = _ranked(both)
        passed = links.df.join(ranked.df.where("next IS NULL AND id % 2 = 0").select(F.shiftright("id", 1).alias("n"), "w").hint("merge"), "n")
        best = passed.groupBy("node").agg(F.max_by("n", "w").alias("best"))
        then = Kept(tree.df.join(best.hint("merge"), "node", "left").select("node", F.coalesce("best", "by").alias("by"), (F.col("best") != F.col("by")).alias("_new")))
        tree.drop()
        tree = then
        if tree.df.where("_new").isEmpty():
            break
        ranked.drop()
        tree.df = tree.df.drop("_new")
    left = ranked.df.where("next IS NULL AND id % 2 = 1").select(F.shiftright("id", 1).alias("n"), "x")
    found = links.df.select(group, "value", "n").join(left.hint("merge"), "n")
    total = found.groupBy(group).agg(F.max("x").alias("_all"))
    return found.join(total, group).select(group, F.col("value").alias("node"), (F.col("_all") - F.col("x")).alias("ord"))


def _ranked(lists: DataFrame) -> Kept:
    """``lists`` (id, next) with the elements ``w`` and the odd ones ``x`` from each to its list's end, where ``next`` is null; those that lead to no end keep a ``next``.

    Pointer jumping: after k joins the elements at most 2^k before an end have come there, so when no more come than before, none will.
    """
    now, ended = Kept(lists.select("id", "next", F.lit(1).cast("long").alias("w"), F.col("id").bitwiseAND(F.lit(1)).cast("long").alias("x"))), -1
    while (count := now.df.where("next IS NULL").count()) != ended:
        ended = count
        ahead = now.df.select(F.col("id").alias("next"), F.col("next").alias("_far"), F.col("w").alias("_w"), F.col("x").alias("_x"))
        more = lambda c: (F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c)
        then = Kept(now.df.join(ahead.hint("merge"), "next", "left").select("id", F.col("_far").alias("next"), more("w"), more("x")))
        now.drop()
        now = then
    return now
