"""The queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import chat, embedding_dedup, exact_dedup, hard_negatives, mixing, ngram_jaccard, packing, quality_classifier, quality_rules, spelling, sql, substring_dedup, token_files, warc

#: Both texts of the extra conversation -1.
MARKS = "</s>[INST] ok [/INST]"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score(docs, model)
    return scored.select(
        "doc.doc_id",
        quality_classifier.held_out("doc.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"), carry=["doc_id"])
    return mixed.select("doc.doc_id", "n_tokens", "source", "lang", "topic", F.round("probability", 4).alias("probability"), "sampled")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.9)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of special tokens inside a text are ordinary text, the way the tokenizers' own notes use them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), words=True, end=1)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", MARKS), (-1, 1, "assistant", MARKS)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(turns.union(extra)))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of special tokens inside a text are ordinary text, the way the tokenizers' own notes use them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), words=False, end=2)
    return token_files.read_tokens(manifest, digest=True).withColumnRenamed("id", "doc_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = warc.write_archives(pages, min_bytes=0)
    # Every page is looked up by its URL.
    return warc.read_records(warc.lookup(manifest, pages), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = substring_dedup.remove_repeats(docs, width=35)
    return done.select("doc.doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, num=90, den=100)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling.variants(spelling.count_words(docs, least_length=6, least_count=5, one_in=199), ratio=5)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.hard_negatives(vectors, every=50, positives=5, negatives=3, share=(50, 95, 100), scale=256.0)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest id stays; equal means equal bytes after lower-casing A-Z."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup.exact_duplicates(docs, keep="largest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_quality_classifier, op2_source_mixing, op3_embedding_dedup, op4_packing, op5_chat_formatting, op6_token_files, op7_warc, op8_substring_dedup, op9_ngram_jaccard_join, op10_quality_rules,
        op11_spelling_variants, op12_hard_negatives, op13_exact_dedup,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """None for the classifier and the two queries that tokenize; tests compare those with plain versions."""
    return {
        "op2_source_mixing": mixing.oracle_sql(),
        "op3_embedding_dedup": sql.EMBEDDINGS,
        "op5_chat_formatting": sql.conversations(MARKS),
        "op7_warc": sql.PAGES,
        "op8_substring_dedup": sql.repeats(35),
        "op9_ngram_jaccard_join": sql.jaccard(3, 90, 100),
        "op10_quality_rules": sql.rules(),
        "op11_spelling_variants": sql.spelling(),
        "op12_hard_negatives": sql.NEGATIVES,
        "op13_exact_dedup": sql.COPIES,
    }
