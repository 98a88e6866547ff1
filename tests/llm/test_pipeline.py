"""The pipeline's stages against plain versions, each on its own input."""

import sys
from pathlib import Path

import public_tokenizers
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers

from lattica.llm import tokens
from lattica.llm.common import sliced

corpus_pipeline = pytest.importorskip("corpus_pipeline")
TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in helpers.corpus(6)]
    return spark.createDataFrame(rows, helpers.DOCS).repartition(3)


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: (x[0], x[1] or ""))


def test_near_duplicates_keep_one_of_each_group(spark, docs):
    want = helpers.jaccard_components([tuple(r) for r in docs.select("doc_id", "text").collect()], 5, 80)
    got = corpus_pipeline.near_duplicates(spark, docs, TABLES)
    assert got.columns == docs.columns and [i for i, _ in texts(got)] == sorted(i for i, (_, c) in want.items() if i == c)


def test_repeated_passages(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = []
    for (i, t), (n, removed, kept) in zip(rows, helpers.remove_repeats(rows)):
        if not removed or removed < n:
            want.append((i, kept if removed else t))
    got = corpus_pipeline.repeated_passages(spark, docs, TABLES)
    assert got.schema.simpleString() == docs.schema.simpleString() and texts(got) == sorted(want, key=lambda x: (x[0], x[1] or ""))


def test_stages_take_extra_columns_and_nothing(spark, docs):
    from pyspark.sql import functions as F

    wide = docs.withColumn("score", F.lit(1)).withColumn("key", F.lit("k")).withColumn("n_words", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, TABLES).columns == wide.columns
        assert stage(spark, wide.limit(0), TABLES).count() == 0


def test_stages_take_odd_column_names_and_repeated_rows(spark, docs):
    """Names that Spark has to quote, names that the operators use themselves, repeated rows and null ids."""
    from pyspark.sql import functions as F

    names = ["a.b", "my col", "x:y", "a-b", "doc", "id", "text_", "_row_key", "tokens", "places", "component_id", "probability", "tick`"]
    odd = docs.union(docs.where("doc_id < 3")).union(spark.createDataFrame([(None, "a b c", None, None, None), (None, None, None, None, 0)], helpers.DOCS))
    for k, name in enumerate(names):
        odd = odd.withColumn(name, F.lit(k))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, TABLES)
        assert got.columns == odd.columns and {tuple(r)[len(docs.columns) :] for r in got.collect()} <= {tuple(range(len(names)))}
    assert corpus_pipeline.packed(spark, odd, TABLES).agg(F.sum("length")).first()[0] > 0


def test_run(spark):
    pieces = corpus_pipeline.run(spark, TABLES).toPandas()
    known = {r["doc_id"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    left = set(pieces.doc_id)
    assert left < known and len(left) > 0.4 * len(known)
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    assert sum(labels.get(i) == 0 for i in left) <= 0.1 * sum(q == 0 for q in labels.values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "substring_dedup", "source_mixing", "packing"]


def test_near_duplicates_tell_rows_of_one_id_apart(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, words(1)), (5, words(1)), (5, words(2)), (7, words(3)), (7, words(3)), (8, words(2)), (9, words(4)), (None, words(5)), (None, words(5))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], helpers.DOCS).repartition(3)
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, TABLES).collect()))
    assert got == sorted([(1, words(1)), (5, words(2)), (7, words(3)), (9, words(4)), (0, words(5)), (0, words(5))])


def test_workers_keep_encoders_for_tasks_that_encode_only():
    """What packing has learned doesn't stay in a worker beside the next run's other stages."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens.encoder(path, True)
    assert list(sliced(iter, encodes=True)(iter([]))) == [] and tokens.encoder.cache_info().currsize > 0
    assert list(sliced(iter)(iter([]))) == [] and tokens.encoder.cache_info().currsize == 0
