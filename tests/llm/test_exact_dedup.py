"""Exact dedup against a plain version, with collisions, hot groups and odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lattica.llm import exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = keep(known) if known else None
        out += [(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


ROWS = [
    (5, "One text"), (3, "one TEXT"), (9, "one text "), (4, "ÄÖ and x"), (6, "ÄÖ AND X"), (7, "äö and x"), (8, None), (10, ""), (11, " "), (None, "alone"), (None, "one text"), (12, "İI"), (13, "İi"), (14, "i̇i"),
    (3, "one TEXT"), (15, "long " * 200_000), (16, "Long " * 200_000), (17, "a\x00b"), (18, "A\x00B"), (19, "aKb"), (20, "akb"),
    *[(k, "Hot" if k % 2 else "hot") for k in range(100, 400)],
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, hash string").repartition(5)


def answer(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("keep, best", [("smallest", min), ("largest", max)])
def test_exact_duplicates(spark, keep, best):
    assert answer(exact_dedup.exact_duplicates(table(spark, ROWS), keep=keep)) == plain(ROWS, best)


def test_collisions_are_told_apart_by_their_bytes(spark):
    """A hash of a few values, so every group of a hash holds several texts, or one of them."""
    for weak in (lambda t: F.lit(b"\x00"), lambda t: F.length(t).cast("string").cast("binary")):
        assert answer(exact_dedup.exact_duplicates(table(spark, ROWS), hash_of=weak)) == plain(ROWS, min)


def test_many_copied_texts_are_grouped_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 1)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 4)
    assert answer(exact_dedup.exact_duplicates(table(spark, ROWS))) == plain(ROWS, min)


def test_without_copies_keeps_one_row_of_each_text_with_all_columns(spark):
    docs = table(spark, ROWS).withColumnsRenamed({"doc_id": "odd `id`", "text": "kept"})
    left = exact_dedup.without_copies(docs, "odd `id`", "kept")
    assert left.columns == docs.columns
    want = {(i, t) for i, _, _, kept, t in plain(ROWS, min) if kept}
    got = [(r[0], hashlib.sha256((r[1] or "").translate(LOWER).encode()).hexdigest()) for r in left.collect()]
    assert len(got) == len(want) and set(got) == want


def test_empty_table_and_text_ids(spark):
    assert exact_dedup.exact_duplicates(table(spark, ROWS).limit(0)).count() == 0
    docs = spark.createDataFrame([("b", "x"), ("a", "X"), ("c", None)], "doc_id string, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_duplicates(docs).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_the_main_path_runs_no_python(spark):
    plan = exact_dedup.exact_duplicates(table(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_an_unknown_choice_is_an_error(spark):
    with pytest.raises(ValueError, match="smallest"):
        exact_dedup.exact_duplicates(table(spark, ROWS), keep="first")
