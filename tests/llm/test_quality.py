"""Classifier, rules and mixing."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import helpers

from lattica.llm import mixing, quality_classifier, quality_rules

TABLES = "/root/testdata/sf0.01"


def test_gradients():
    model = quality_classifier.ByteConv(1)
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    r = np.random.default_rng(0)
    texts, labels = [bytes(r.integers(32, 120, n, dtype=np.uint8)) for n in (10, 300, 700, 1500)], np.array([0, 1, 0, 1])
    _, found = model.gradients(texts, labels)
    for k in ("embed", "filters", "hidden", "hidden_offset", "out", "out_offset"):
        flat = model.params[k].reshape(-1)
        for i in r.integers(0, len(flat), 3):
            old = flat[i]
            flat[i] = old + 1e-5
            high = model.gradients(texts, labels)[0]
            flat[i] = old - 1e-5
            low = model.gradients(texts, labels)[0]
            flat[i] = old
            assert abs((high - low) / 2e-5 - found[k].reshape(-1)[i]) < 1e-6


def test_scoring_sends_each_text_once(spark):
    """A task's batch lies on the JVM's side and on Python's, so a second copy of its texts counts twice."""
    docs = spark.createDataFrame([(1, "a b c", "en"), (2, None, "de")], "doc_id long, `Te xt` string, lang string")
    model = quality_classifier.ByteConv(2)
    got = quality_classifier.score(docs, model, text_column="te xt")
    assert re.search(r"MapInArrow [^(]*\(doc#\d+\)", got._jdf.queryExecution().executedPlan().toString())
    want = model.scores([b"a b c", None])
    assert np.allclose([r["score"] for r in sorted(got.collect(), key=lambda r: r["doc"]["doc_id"])], want)


def test_scores_do_not_depend_on_neighbours():
    model = quality_classifier.ByteConv(2)
    texts = [b"a", None, b"", b"x y " * 700, bytes(range(256)) * 3]
    alone = [float(model.scores([t])[0]) for t in texts]
    assert np.allclose(model.scores(texts), alone, atol=1e-6) and alone[1] == alone[2] == 0
    long = b"word " * 200_000  # beyond what goes at once
    assert abs(model.scores([long])[0] - model.forward([long])[0]) < 1e-4


def plain_score(p, text):
    """The network a filter and a chunk at a time, in double precision: filters of 8 bytes by 4, pooled over 64, chunks of 512 by 256."""
    if not text:
        return 0.0
    groups = max(2, -(-len(text) // 256))
    codes = list(text) + [256] * (groups * 256 - len(text))
    embedded = np.concatenate([p["embed"].astype(float)[codes], np.zeros((4, quality_classifier.EMBEDDING))])
    conv = np.array([np.maximum(embedded[k : k + 8].reshape(-1) @ p["filters"].astype(float) + p["offset"], 0) for k in range(0, groups * 256, 4)])
    blocks = [conv[k : k + 16] for k in range(0, len(conv), 16)]
    pooled = np.array([np.concatenate([x.mean(0), x.max(0)]) for x in blocks])
    real = -(-len(text) // 64)
    best = np.zeros(quality_classifier.HIDDEN)
    for g in range(groups - 1):
        mine = pooled[4 * g : min(4 * g + 8, max(real, 4 * g))]
        mean = mine.mean(0) if len(mine) else np.zeros(pooled.shape[1])
        square = (mine**2).mean(0) if len(mine) else np.zeros(pooled.shape[1])
        chunk = np.concatenate([mean, np.sqrt(np.maximum(square - mean**2, 0) + quality_classifier._EPS)])
        best = np.maximum(best, chunk @ p["hidden"].astype(float) + p["hidden_offset"])
    return float(1 / (1 + np.exp(-(best @ p["out"].astype(float) + p["out_offset"][0]))))


def test_query_is_the_plain_network(spark, tmp_path):
    """All of op1's columns, over texts of every length about the blocks' edges, repeated rows and null ids."""
    import zlib

    from lattica.llm import queries

    r = random.Random(3)
    texts = [None, "", "a", *["".join(r.choice("abc é#\n") for _ in range(n)) for n in (7, 8, 63, 64, 65, 255, 256, 257, 511, 512, 513, 767, 768, 1500, 5000)]]
    rows = [(k, t) for k, t in enumerate(texts)] * 2 + [(3, "another text"), (None, "no id")] + [(100 + k, f"good words {k} of text " * (k % 9 + 1) if k % 2 else "#$% " * (k + 3)) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + k, k % 2) for k in range(60)] + [(None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    model = quality_classifier.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    got = queries.op1_quality_classifier(spark, str(tmp_path)).collect()
    key = lambda i, s: (-1 if i is None else i, s)
    found, want = sorted(key(x["doc_id"], x["score"]) for x in got), sorted(key(i, plain_score(model.params, (t or "").encode())) for i, t in rows)
    assert [i for i, _ in found] == [i for i, _ in want] and np.allclose([s for _, s in found], [s for _, s in want], atol=2e-4)
    for x in got:
        assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2)
        assert x["predicted"] == int(x["score"] >= 0.7) and 0 <= x["score"] <= 1
    # The labels, read by another order of the rows and with the held-out ones turned round, give the same network.
    turned = spark.createDataFrame([(100 + k, (k + (zlib.crc32(str(100 + k).encode()) % 4 == 2)) % 2) for k in reversed(range(60))], "doc_id long, quality int")
    again = quality_classifier.train(spark.read.parquet(f"{tmp_path}/documents.parquet").repartition(2), turned)
    assert all((again.params[k] == v).all() for k, v in model.params.items())
    # A label that is repeated counts once, and ids with both labels teach nothing, in whatever order they are read.
    both = spark.createDataFrame([(k, 0) for k in (3, 4, 10)] + [(k, 1) for k in (10, 4, 3)] + [(101, 1)] * 3, "doc_id long, quality int")
    more = turned.union(both).repartition(3)
    again = quality_classifier.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), more)
    assert all((again.params[k] == v).all() for k, v in model.params.items())


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet")
    model = quality_classifier.train(docs, labels)
    scored = quality_classifier.score(docs.withColumnRenamed("lang", "score"), model)  # a clashing name
    rows = scored.join(labels, scored["doc.doc_id"] == labels["doc_id"]).select(quality_classifier.held_out("doc_id").alias("h"), scored["score"], "quality").where("h").collect()
    assert np.mean([(r["score"] >= 0.7) == r["quality"] for r in rows]) > 0.93
    assert quality_classifier.score(docs.limit(0), model).count() == 0
    assert quality_classifier.score(spark.createDataFrame([(1, None)], "doc_id long, text string"), model).first()["score"] == 0


def plain_statistics(text):
    w, raw = helpers.words(text), text or ""
    counts, covered = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if counts[w[k], w[k + 1], w[k + 2]] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in raw.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", raw)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    r = random.Random(1)
    rows = helpers.corpus() + [(900 + k, "".join(r.choice(["a", "b ", "a b\n", "é|", " ", "\n", "##", "\t", " "]) for _ in range(80))) for k in range(100)]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, 1) for i, t in rows], "doc_id long, text string, lang string, kept int").repartition(3)
    got = quality_rules.quality_rules(docs).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for x in got:
        stats = (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"])
        assert stats == plain_statistics(texts[x["doc_id"]])
        assert x["base_failed"] == (stats[0] < 50 or 100 * stats[4] > 50 * stats[0]) and not (x["base_failed"] and x["kept"])
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_distances(spark):
    def js(p, q):
        p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
        m = (p + q) / 2
        part = lambda x: np.sum(np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0))
        return np.sqrt((part(p) + part(q)) / 2)

    def found(rows):
        df = spark.createDataFrame([(p, sum(p), q) for p, q in rows], "p array<long>, n long, q array<double>")
        shares = quality_rules._shares(F.col("q"), F.aggregate("q", F.lit(0.0), lambda s, x: s + x))
        return [r["d"] for r in df.withColumn("q", shares).select(quality_rules._distance("p", "n", "q").alias("d")).collect()]

    rows = [([1, 2, 3], [3.0, 2.0, 1.0]), ([1, 0, 0], [0.0, 1.0, 0.0]), ([5, 5, 0], [1.0, 1.0, 0.0])]
    assert np.allclose(found(rows), [js(p, q) for p, q in rows])
    assert found([([0, 0], [1.0, 1.0]), ([1, 0], None), ([1, 0], [0.0, 0.0])]) == [0.0, 0.0, 0.0]


def test_rules_tell_labels_apart(spark):
    got = quality_rules.quality_rules(spark.read.parquet(f"{TABLES}/documents.parquet")).join(spark.read.parquet(f"{TABLES}/labels.parquet"), "doc_id").collect()
    good, bad = ([r["kept"] for r in got if r["quality"] == q and r["n_words"] >= 50] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.08


def test_mixing_equals_sql(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    got = {r["doc"]["doc_id"]: (r["n_tokens"], r["topic"], round(r["probability"], 4), r["sampled"]) for r in mixing.mix(docs).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{TABLES}/documents.parquet'")
    want = con.execute(mixing.oracle_sql()).fetchall()
    assert got == {r[0]: (r[1], r[4], r[5], r[6]) for r in want}


def test_carried_columns_are_drawn_alike(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    key = lambda df: sorted((r["doc"]["doc_id"], r["n_tokens"], r["topic"], round(r["probability"], 9), r["sampled"]) for r in df.collect())
    slim = mixing.mix(docs, carry=["doc_id"])
    assert slim.schema["doc"].dataType.names == ["doc_id"] and key(slim) == key(mixing.mix(docs))
    named = mixing.mix(docs.withColumn("my.topic", F.col("doc_id") % 3), topic_column="my.topic", temper=1.0)
    assert {r["topic"] for r in named.select("topic").distinct().collect()} == {"0", "1", "2"}


def test_mixing_edge_cases(spark):
    rows = [(1, None, None, None), (None, "a b", "en", "s"), (1, "", "en", "s"), (2, "x " * 50, "en", "s"), (2, "x " * 50, "en", "s")]
    got = mixing.mix(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, source string, topic int")).collect()
    assert len(got) == 5 and all(0 <= r["probability"] <= 1 for r in got) and {r["doc"]["topic"] for r in got} == {5}
    assert mixing.mix(spark.createDataFrame([], helpers.DOCS)).count() == 0


def test_raking_meets_targets_although_cells_are_used_up(spark):
    r = np.random.default_rng(1)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", int(r.integers(1, 10**4) ** 1.5)) for a in range(6) for b in range(3) for c in range(3)], "source string, lang string, topic string, tokens long")
    every = cells.toPandas()
    targets = {"lang": {f"l{b}": float(x) for b, x in enumerate([0.45, 0.3, 0.25])}}
    share = lambda df, d: (df.tokens * df.probability).groupby(df[d]).sum() / (df.tokens * df.probability).sum()
    found, residual = mixing.rake(cells, 0.7, targets=targets)
    found = found.toPandas()
    assert residual <= mixing.REACHED and (found.probability == 1).any() and len(found) == len(every) and found.probability.max() <= 1
    assert np.isclose((found.tokens * found.probability).sum(), 0.7 * every.tokens.sum(), rtol=1e-5)
    assert np.allclose(share(found, "lang"), [0.45, 0.3, 0.25], atol=1e-5)
    for d in ("source", "topic"):
        tempered = every.groupby(d).tokens.sum().astype(float) ** 0.7
        assert np.allclose(share(found, d), tempered / tempered.sum(), atol=1e-5)


def test_raking_takes_all_of_a_target_out_of_reach(spark):
    cells = spark.createDataFrame([("s", lang, t, n) for lang, n in (("a", 10), ("b", 600), ("c", 300)) for t in "xy"], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="'a'"):
        found, residual = mixing.rake(cells, 0.5, targets={"lang": {"a": 0.5, "b": 0.25, "c": 0.25}})
    kept = found.toPandas().assign(kept=lambda x: x.tokens * x.probability).groupby("lang").kept.sum()
    # What "a" can't give is shared by the others as their targets are to each other.
    assert residual < 1e-6 and np.allclose(kept, [20, 445, 445], atol=1e-2)


def test_mix_uses_the_raked_probabilities(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    with pytest.warns(UserWarning, match="taken whole"):
        got = mixing.mix(docs).toPandas()
    by = lambda d, x: x.groupby(got[d]).sum()
    expected, total = got.n_tokens * got.probability, got.n_tokens.sum()
    assert got.probability.between(0, 1).all() and np.isclose(expected.sum(), 0.8 * total, rtol=1e-4)
    tempered = by("source", got.n_tokens).astype(float) ** 0.7
    assert np.allclose(by("source", expected) / expected.sum(), tempered / tempered.sum(), atol=1e-4)


def test_targets_out_of_reach_together_are_told(spark):
    """All of "a" is of the source "s", but each is asked to give what the other can't."""
    cells = spark.createDataFrame([("s", "a", "x", 100), ("t", "b", "x", 900)], "source string, lang string, topic string, tokens long")
    _, residual = mixing.rake(cells, 0.1, targets={"source": {"s": 0.9, "t": 0.1}, "lang": {"a": 0.1, "b": 0.9}})
    assert residual > 0.1


def test_targets_may_list_only_some_values(spark):
    cells = spark.createDataFrame([("s", lang, t, n) for lang, n in (("a", 100), ("b", 400), ("c", 900)) for t in "xy"], "source string, lang string, topic string, tokens long")
    b, c = 800**0.7, 1800**0.7
    for given, want in ((0.25, [0.25, 0.75 * b / (b + c), 0.75 * c / (b + c)]), (2, np.array([200**0.7, b, c]) / (200**0.7 + b + c))):
        raked = mixing._with_targets(cells, mixing.DIMENSIONS, {"lang": {"a": given}}, 0.7).toPandas()
        assert np.allclose(raked.groupby("lang").target_lang.first() / 2800, want)
