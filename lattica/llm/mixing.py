"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are summed to cells (source, language, topic).  The cells' token weights are raked: each
step scales them to the target marginal of one dimension, in turn, under the bound that a cell gives
its tokens once at most.  A document is kept with its cell's calibrated probability, so that the
expected tokens have the target marginals; the draw is a hash of the id, so it can be repeated.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import Kept, col, whole_row

DIMENSIONS = ("source", "lang", "topic")
#: Rounds (every dimension once) between two written tables, and at most; the part of the tokens that may be amiss at the end.
WRITTEN, MOST_ROUNDS, REACHED = 5, 200, 1e-11
#: Cells that one task rakes, and that may be broadcast.
FEW_CELLS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    """What kind of text it is, by plain rules."""
    return (
        F.when(F.contains(text, F.lit("icense")), "licence")
        .when(F.regexp_like(text, F.lit("[0-9]{3}")), "figures")
        .when(tokens < 100, "short")
        .when(tokens < 600, "middle")
        .otherwise("long")
    )


def draw(id_column: Column) -> Column:
    """A number in [0, 1) from the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def _with_targets(cells: DataFrame, dimensions: tuple[str, ...], targets: dict[str, dict[str, float]] | None, temper: float) -> DataFrame:
    """``cells`` with ``target_`` of each dimension: the tokens that its value should have; they add up to all tokens."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    for d in dimensions:
        sums = F.sum("tokens").over(Window.partitionBy(d)).cast("double")
        share = F.pow(sums, F.lit(float(temper)))
        given = (targets or {}).get(d)
        if given:
            wanted = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
            listed = F.col(d).isin(list(given))
            values = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(float(temper))).alias("x"))
            every, others = values.agg(F.sum("x"), F.sum(F.when(listed, 0.0).otherwise(F.col("x")))).first()
            asked = float(sum(given.values()))
            if others:
                # Others get what shares below one leave, else their tempered part of the whole.
                left = 1 - asked if asked < 1 else others / every
                wanted_part, other_part = (1 - left) / (asked or 1.0), left / others
                share = F.when(listed, F.element_at(wanted, F.col(d)) * F.lit(wanted_part)).otherwise(share * F.lit(other_part))
            else:
                share = F.element_at(wanted, F.col(d)).cast("double")
        cells = cells.withColumn(f"share_{d}", share)
    for d in dimensions:
        once = cells.groupBy(d).agg(F.max(f"share_{d}").alias("x")).agg(F.sum("x")).first()[0] or 1.0
        cells = cells.withColumn(f"target_{d}", F.col(f"share_{d}") / F.lit(float(once)) * F.lit(float(total))).drop(f"share_{d}")
    return cells


def rake(cells: DataFrame, keep_share: float, dimensions: tuple[str, ...] = DIMENSIONS, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.7) -> tuple[DataFrame, float]:
    """(``cells`` (a row a cell, with ``tokens``) with ``probability``, the part of the tokens by which a marginal misses its target).

    A target is a dimension's shares by value, which need not add up to one; values without one, and
    dimensions without targets, take their tokens to the power ``temper``: the former of what shares that
    add up to less than one leave, else of the whole.  All are parts of ``keep_share`` of the tokens.
    One that exceeds its value's tokens is out of reach: it becomes those tokens, and the other values of
    the dimension share the rest as their targets are to each other.

    A step scales a value's cells by the factor at which they meet its target although some are used
    up, so these stay at their tokens and the others are raked again.  It ends when all marginals
    are met to REACHED of the tokens, or when WRITTEN rounds bring them nearer by less than a hundredth, since
    targets can be out of reach together; the rest is returned.  Cells without tokens have ``keep_share``.
    """
    cells = _with_targets(cells, dimensions, targets, temper)
    # Few cells go to one partition, so that no window has to be shuffled.
    few = cells.count() <= FEW_CELLS
    cells = cells.coalesce(1) if few else cells
    for d in dimensions:
        values = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("tokens"), F.max(f"target_{d}").alias("weight"))
        wanted = keep_share * (values.agg(F.sum("weight")).first()[0] or 0.0)
        at, factor = _filling("wanted", "all", d)
        reached = values.withColumns({"wanted": F.lit(float(wanted)), "all": F.lit(1)}).select("*", at).withColumn("factor", factor)
        short = [r[0] for r in values.where(F.col("tokens") < keep_share * F.col("weight") * (1 - 1e-6)).select(d).orderBy(d).limit(20).collect()]
        if short:
            warnings.warn(f"targets beyond all tokens of a {d}, which are taken whole (20 named at most): {', '.join(map(repr, short))}", stacklevel=3)
        goals = reached.select(d, F.least("tokens", F.col("weight") * F.col("factor")).alias(f"goal_{d}"))
        cells = cells.join(goals, d).drop(f"target_{d}")
    now, residual = Kept(cells.withColumn("weight", F.col("tokens").cast("double")), "cells"), float("inf")
    fixed = [F.col(c) for c in cells.columns]
    steps = [(at, [*fixed, (F.col("weight") * factor).alias("weight")]) for at, factor in (_filling(f"goal_{d}", d, *dimensions) for d in dimensions)]
    for _ in range(0, MOST_ROUNDS, WRITTEN):
        cells = now.df.coalesce(1) if few else now.df
        for _ in range(WRITTEN):
            for at, scaled in steps:
                cells = cells.select("*", at).select(*scaled)
        before, now = now, Kept(cells, "cells")
        before.drop()
        last, residual = residual, _residual(now.df, dimensions)
        if residual <= REACHED or residual > 0.99 * last:
            break
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") / F.greatest("tokens", F.lit(1)))).otherwise(F.lit(min(1.0, float(keep_share))))
    return now.df.withColumn("probability", chance).drop("weight", *[f"goal_{d}" for d in dimensions]), residual


def _residual(cells: DataFrame, dimensions: tuple[str, ...]) -> float:
    """The part of the tokens by which the marginals of the worst dimension miss their goals."""
    sides = F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).alias("v"), F.col(f"goal_{d}").alias("goal")) for d in dimensions])
    each = cells.select(F.least("tokens", "weight").alias("x"), F.explode(sides).alias("e")).groupBy("e.d", "e.v").agg(F.sum("x").alias("x"), F.max("e.goal").alias("goal"))
    parts = each.groupBy("d").agg(F.try_divide(F.sum(F.abs(F.col("x") - F.col("goal"))), F.sum("goal")).alias("miss"))
    return float(parts.agg(F.max("miss")).first()[0] or 0.0)


def _filling(goal: str, group: str, *tie: str) -> tuple[Column, Column]:
    """Two columns, one after the other: ``at``, and the factor with which the sum of least(tokens, factor * weight) of each group is its goal, or all of its tokens.

    With the cells that are used up first in front, each k gives the factor at which the first k are used
    up; it's never too large, and exact for the right k, so the largest one is taken.
    """
    w = Window.partitionBy(group)
    rank = w.orderBy(F.try_divide("tokens", "weight").asc_nulls_last(), *tie)
    tokens, weight = F.col("tokens").cast("double"), F.col("weight")
    used = F.coalesce(F.sum(tokens).over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum(weight).over(rank.rowsBetween(0, Window.unboundedFollowing))
    # Sums of rounding errors mustn't leave a goal just beyond the tokens.
    wanted = F.least(F.col(goal), F.sum(F.when(weight > 0, tokens).otherwise(0.0)).over(w))
    return F.when(weight > 0, (wanted - used) / open_).alias("at"), F.greatest(F.coalesce(F.max("at").over(w), F.lit(0.0)), F.lit(0.0))


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    lang_column: str = "lang",
    topic_column: str | None = None,
    keep_share: float = 0.8,
    targets: dict[str, dict[str, float]] | None = None,
    temper: float = 0.7,
    carry: list[str] | None = None,
) -> DataFrame:
    """(doc, n_tokens, source, lang, topic, probability, sampled) of every row; ``doc`` holds all its columns, or those of ``carry``.

    With ``carry``, which has to hold the id, these facts are written once, so texts are read once;
    else they are read again with the result, which is cheaper than writing them.  Targets are as in ``rake``; a
    warning tells by how much they are missed.  The topic is ``topic_column``, or what plain rules say.
    Null and empty texts have no tokens and go to the topic "short"; null sources, languages and
    topics are values of their own ("", "" and "short").  Rows that repeat an id are drawn alike, null ids like each other.
    Columns of ``docs`` keep their names inside ``doc``, so none can clash.
    """
    tokens = word_count(col(text_column))
    kind = col(topic_column).cast("string") if topic_column else topic(col(text_column), tokens)
    rows = docs.select(
        (whole_row(docs) if carry is None else F.struct(*[col(c).alias(c) for c in carry])).alias("doc"),
        tokens.alias("n_tokens"),
        F.coalesce(col(source_column).cast("string"), F.lit("")).alias("source"),
        F.coalesce(col(lang_column).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(kind, F.lit("short")).alias("topic"),
    )
    if carry is not None:
        rows = Kept(rows, "facts").df
    cells = Kept(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells").df
    chosen, residual = rake(cells, keep_share, targets=targets, temper=temper)
    if residual > 1e-6:
        warnings.warn(f"the targets are out of reach together: {residual:.4f} of the tokens are amiss in a dimension", stacklevel=2)
    found = Kept(chosen.select(*DIMENSIONS, "probability"), "probabilities").df
    few = found.count() <= FEW_CELLS
    out = rows.join(F.broadcast(found) if few else found, list(DIMENSIONS), "left")
    return out.select("doc", "n_tokens", *DIMENSIONS, "probability", (draw(F.col("doc")[id_column]) < F.col("probability")).alias("sampled"))


def oracle_sql(keep_share: float = 0.8, temper: float = 0.7, rounds: int = 250) -> str:
    """The same chances by another way: every step scales the weights of a value, tokens being the least of weight and tokens.

    It has the same limit, more slowly; weights of values whose target is all of their tokens start beyond any bound.
    """
    targets, goals = [], []
    for d in DIMENSIONS:
        targets.append(f"t_{d} AS (SELECT {d}, s, x / sum(x) OVER () * (SELECT sum(tokens) FROM cells) AS target FROM (SELECT {d}, sum(tokens)::DOUBLE AS s, pow(sum(tokens)::DOUBLE, {temper}) AS x FROM cells GROUP BY ALL))")
        # Of the values in order of their reach, the first k are taken whole and the others share what is left.
        goals.append(
            f"""g_{d} AS (SELECT {d}, least(s, target * (SELECT max(({keep_share} * total - used) / rest) FROM (SELECT sum(s) OVER w - s AS used, sum(target) OVER () - sum(target) OVER w + target AS rest, sum(s) OVER () AS total
  FROM t_{d} WINDOW w AS (ORDER BY s / target, {d})))) AS goal, s FROM t_{d})"""
        )
    step = lambda inner, d: f"SELECT n, source, lang, topic, tokens, goal_source, goal_lang, goal_topic, weight * goal_{d} / sum(least(tokens, weight)) OVER (PARTITION BY {d}) AS weight FROM ({inner})"
    inner = f"SELECT n + 1 AS n, * EXCLUDE (n) FROM w WHERE n < {rounds}"
    for d in DIMENSIONS:
        inner = step(inner, d)
    whole = " OR ".join(f"goal_{d} >= s_{d} * (1 - 1e-12)" for d in DIMENSIONS)
    named = " ".join(f"JOIN (SELECT {d}, goal AS goal_{d}, s AS s_{d} FROM g_{d}) USING ({d})" for d in DIMENSIONS)
    return rf"""WITH RECURSIVE rows AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS n_tokens, coalesce(source, '') AS source, coalesce(lang, '') AS lang, text FROM documents),
kinds AS MATERIALIZED (SELECT doc_id, n_tokens, source, lang, CASE WHEN contains(text, 'icense') THEN 'licence' WHEN regexp_matches(text, '[0-9]{{3}}') THEN 'figures'
  WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 600 THEN 'middle' ELSE 'long' END AS topic FROM rows),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM kinds GROUP BY ALL), {", ".join(targets + goals)},
w AS (SELECT 0 AS n, source, lang, topic, tokens, goal_source, goal_lang, goal_topic, CASE WHEN {whole} THEN tokens * 1e100 ELSE tokens END AS weight FROM cells {named}
UNION ALL {inner}),
p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1, weight / tokens) ELSE {keep_share} END AS probability FROM w WHERE n = {rounds})
SELECT doc_id, n_tokens::BIGINT AS n_tokens, source, lang, topic, round(probability, 4) AS probability,
  ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296 < probability AS sampled FROM kinds JOIN p USING (source, lang, topic)"""
