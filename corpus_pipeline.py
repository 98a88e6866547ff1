"""Corpus pipeline: quality, near-duplicates, repeated passages, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
documents.  The driver writes each stage's table as Parquet and reads it again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import mixing, ngram_jaccard, packing, quality_classifier, substring_dedup
from lattica.llm.common import BROADCAST_KEYS, Kept, filter_by, quoted

#: Documents that score less are rejected.
LEAST_SCORE = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels that aren't held out, doesn't reject."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs, model).where(F.col("score") >= LEAST_SCORE).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8: the one of the least id.

    A row that repeats another's id and text goes; rows that share an id but not the text are documents of their own.
    Null ids aren't repeats of each other's texts, and link with nothing.
    """
    row_key = "_row_key"  # tells rows apart although they share an id
    while row_key in docs.columns:
        row_key += "_"
    near = lambda rows, key: ngram_jaccard.jaccard_components(rows, id_column=key, width=5, num=80, den=100)
    repeated = Kept(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated").df
    if repeated.isEmpty():
        others = Kept(near(docs, "doc_id").where("component_id != doc_id").select("doc_id"), "others").df
        return filter_by(docs, others, "doc_id", anti=True)
    once = filter_by(docs, repeated, "doc_id", anti=True).withColumn(row_key, F.col("doc_id").cast("long"))
    again = filter_by(docs, repeated, "doc_id").dropDuplicates(["doc_id", "text"]).withColumn(row_key, F.xxhash64("doc_id", "text"))
    rows = Kept(once.unionByName(again), "rows").df
    groups = Kept(near(rows, row_key).where(f"{row_key} IS NOT NULL").join(rows.select(row_key, "doc_id"), row_key), "groups").df
    # A group is named by its least key; where that isn't the row of the least id, this one is kept instead.
    firsts = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", row_key))[row_key].alias("first"))
    named = Kept(firsts.where("first != component_id"), "named").df
    few = named.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    told = groups.join(F.broadcast(named) if few else named, "component_id", "left")
    others = Kept(told.where(F.col(row_key) != F.coalesce("first", "component_id")).select(row_key), "others").df
    return filter_by(rows, others, row_key, anti=True).select(*map(quoted, docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words under repeated windows of 35 words; those of which nothing is left go."""
    done = substring_dedup.remove_repeats(docs, width=35).where("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("doc.n_chars"))
    return done.select(*[new.get(c, F.col(f"doc.{quoted(c)}")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics get their tempered shares of tokens, or all that there are."""
    return mixing.mix(docs, keep_share=0.8, temper=0.7).where("sampled").select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), words=True, end=1)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", source_mixing),
    ("packing", packed),
]

#: The classifier, the similarity join and the tokenizer have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Kept(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
