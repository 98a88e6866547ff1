"""Incremental counterparts of the ordered map, the edge table, the priority queue and stored interpolants.

The state is Spark's, kept by key and recovered from the query's checkpoint.  Map and edges are
streaming aggregations; the queue keeps no more than ``k`` rows a group.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lattica.operators import interpolants


def upsert_stream(writes: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """(key, value): the last write of each key so far; for the update or complete mode."""
    return writes.groupBy(key).agg(F.max_by(value, seq).alias(value))


def first_edges_stream(edges: DataFrame, seq: str) -> DataFrame:
    """(src, dst, weight): the first edge between two nodes so far keeps its weight."""
    return edges.groupBy("src", "dst").agg(F.min_by("weight", seq).alias("weight"))


def map_stream(writes: DataFrame, key: str, value: str, seq: str, removed: str) -> DataFrame:
    """(key, value, removed): what the write of the largest ``seq`` of each key so far did, set its value or (where ``removed``) take it away.

    Batches may come in any order; for the update mode (a row with ``removed`` deletes the key downstream) or, without such rows, the complete mode.
    """
    last = F.max_by(F.struct(F.col(value).alias("v"), F.coalesce(removed, F.lit(False)).alias("r")), seq)
    found = writes.groupBy(key).agg(last.alias("_w"))
    return found.select(key, F.when(~F.col("_w.r"), F.col("_w.v")).alias(value), F.col("_w.r").alias("removed"))


def edges_stream(changes: DataFrame, seq: str, removed: str) -> DataFrame:
    """(src, dst, weight): the edge between two nodes after all changes so far, in the order of ``seq``; a null weight tells that there is none.

    The first insertion since the last removal keeps its weight.  The state of two nodes holds the last removal and the insertions after it, so
    changes may come in any order; for the update mode, a row for each two nodes that have changes in a batch.
    """

    def apply(key: tuple, frames, state: GroupState):
        cut, seqs, weights = state.get if state.exists else (None, [], [])
        held = list(zip(seqs, weights))
        for frame in frames:
            for at, weight, gone in zip(frame["_s"].tolist(), frame["_w"].tolist(), frame["_r"].tolist()):
                if gone:
                    cut = at if cut is None else max(cut, at)
                else:
                    held.append((at, weight))
        held = sorted(x for x in held if cut is None or x[0] > cut)
        state.update((cut, [s for s, _ in held], [w for _, w in held]))
        yield pd.DataFrame({"src": [key[0]], "dst": [key[1]], "weight": pd.Series([held[0][1] if held else None], dtype="float64")})

    slim = changes.select("src", "dst", F.col(seq).cast("long").alias("_s"), F.col("weight").cast("double").alias("_w"), F.coalesce(removed, F.lit(False)).alias("_r"))
    kinds = ", ".join(f"{c} {changes.schema[c].dataType.simpleString()}" for c in ("src", "dst"))
    return slim.groupBy("src", "dst").applyInPandasWithState(apply, f"{kinds}, weight double", "cut long, seqs array<long>, weights array<double>", "update", GroupStateTimeout.NoTimeout)


def heap_stream(rows: DataFrame, group: str, priority: str, tiebreak: str, k: int) -> DataFrame:
    """(group, ord, priority, tiebreak): the ``k`` least rows of each group that got new ones, for the update mode; equal rows each count."""
    kind = rows.schema[group].dataType.simpleString()

    def push(key: tuple, frames, state: GroupState):
        held = list(zip(*state.get)) if state.exists else []
        for frame in frames:
            held = sorted([*held, *zip(frame["_p"].tolist(), frame["_t"].tolist())])[:k]
        if held:
            state.update(tuple(map(list, zip(*held))))
        yield pd.DataFrame({group: [key[0]] * len(held), "ord": range(len(held)), "priority": [p for p, _ in held], "tiebreak": [t for _, t in held]})

    slim = rows.select(group, F.col(priority).cast("double").alias("_p"), F.col(tiebreak).cast("long").alias("_t"))
    return slim.groupBy(group).applyInPandasWithState(push, f"{group} {kind}, ord long, priority double, tiebreak long", "p array<double>, t array<long>", "update", GroupStateTimeout.NoTimeout)


def interpolants_stream(samples: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, interpolant): as ``interpolants.build`` of all samples so far gives, up to the order of its nodes; for the update mode.

    A batch's nodes update the stored weights and differences, n operations a node; the samples before aren't read again.  Samples without a
    place or a value are no nodes; a place that the group has already is an error.
    """
    kind = samples.schema[group].dataType.simpleString()

    def take(key: tuple, frames, state: GroupState):
        places, values, weights, last, diag = map(list, state.get) if state.exists else ([], [], [], [], [])
        for frame in frames:
            for at, value in sorted(zip(frame["_x"].tolist(), frame["_y"].tolist())):
                gaps = [at - p for p in places]
                if 0.0 in gaps:
                    raise ValueError("an interpolant has this x already")
                weights = [*(-w / g for w, g in zip(weights, gaps)), 1 / math.prod(gaps)]
                row = [value]
                for before, gap in zip(last, reversed(gaps)):
                    row.append((row[-1] - before) / gap)
                last = row
                places.append(at)
                values.append(value)
                diag.append(row[-1])
        found = (places, values, weights, last, diag)
        state.update(found)
        yield pd.DataFrame({group: [key[0]], **{p: [v] for p, v in zip(interpolants.PARTS, found)}})

    slim = samples.select(group, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    found = slim.groupBy(group).applyInPandasWithState(take, f"{group} {kind}, {interpolants.SCHEMA}", interpolants.SCHEMA, "update", GroupStateTimeout.NoTimeout)
    return found.select(group, F.struct(*interpolants.PARTS).alias("interpolant"))


def windowed_integral(samples: DataFrame, time: str, group: str, value: str, window: str, late: str) -> DataFrame:
    """(window, group, integral): the trapezoids between each window's samples, over seconds, once the watermark has passed it.

    The state holds a window's samples; a window of one sample gives 0.
    """
    sample = F.struct(F.unix_micros(F.col(time)).alias("at"), F.col(value).cast("double").alias("y"))
    found = samples.withWatermark(time, late).groupBy(F.window(time, window), group).agg(F.array_sort(F.collect_list(sample)).alias("_s"))
    n = F.size("_s") - 1
    areas = F.zip_with(F.slice("_s", 1, n), F.slice("_s", 2, n), lambda a, b: (b["at"] - a["at"]) / F.lit(2e6) * (a["y"] + b["y"]))
    return found.select("window", group, F.aggregate(areas, F.lit(0.0), lambda s, v: s + v).alias("integral"))
