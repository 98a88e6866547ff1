"""Quality rules: base statistics, and divergence from language references.

One pass over the texts gives each document's statistics and two histograms: its characters by
class, and its words by whether they are common words of the document's language.  Summed over all
documents of a language that meet the base rules, the histograms are the language's references.  A
document is rejected by the base rules, or if the Jensen-Shannon distance of a histogram from its
reference is beyond a threshold, provided that the document is long enough for that histogram to
mean something.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Kept, col, sliced

#: Common words by language (fixed values).
COMMON_WORDS = {
    "en": "the of and a to in is was that for it with as on be at by this from or an are not which",
    "fr": "le la les de des du et un une en que qui dans pour sur au est par plus ne pas il elle ce",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an",
    "es": "el la los las de y que en un una por con para del se al su es lo como más no o",
}
#: Classes of characters: lower-case and upper-case ASCII letters, digits, marks of sentences, other
#: ASCII marks, anything beyond ASCII.  White space isn't counted.
CLASSES = 6
_CLASS = np.full(256, -1)
_CLASS[0x21:0x7F] = 4
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 3
_CLASS[0xC0:] = 5
_CLASS[0x01:0x09] = _CLASS[0x0E:0x20] = _CLASS[0x7F] = _CLASS[0] = 4
_BY_CLASS = (_CLASS[:, None] == np.arange(CLASSES)).astype(np.int64)
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text holds twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    base = len(seen)
    pairs = ids[:-1] * base + ids[1:]
    if base > 2_000_000:  # three of them could pass 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * base + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= again
    return int(covered.sum())


def _dup_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _statistics(common: dict[str, list[bytes]]):
    sets = {lang: {w: i for i, w in enumerate(words)} for lang, words in common.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for value, lang in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
                raw = value.as_py() or b""
                words = raw.split()
                counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                classes = counts @ _BY_CLASS
                vocabulary = sets.get(lang or "", {})
                shares = np.zeros(len(vocabulary) + 1, np.int64)
                if vocabulary:
                    known = [vocabulary[w] for w in raw.lower().split() if w in vocabulary]
                    shares[:-1] = np.bincount(np.array(known, np.int64), minlength=len(vocabulary))
                    shares[-1] = len(words) - len(known)
                out.append((len(words), int(classes.sum()), int(counts[_SYMBOLS].sum()), _dup_lines(raw), _repeat_words(words), classes.tolist(), shares.tolist()))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "shares"])

    return run


def _sum_arrays(column: str, width: int) -> Column:
    return F.array(*[F.sum(F.get(column, F.lit(i))).cast("double") for i in range(width)])


def _shares(histogram: Column, total: Column) -> Column:
    """A histogram as parts of one; null if it is empty."""
    return F.when(total > 0, F.transform(histogram, lambda x: x / total))


def _distance(mine: str, total: str, reference: str) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram, whose sum is ``total``, and shares; 0 if either is empty or absent."""

    def part(x, middle):
        return F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)

    def term(x, q):
        p = x / F.col(total)
        middle = (p + q) / 2
        return (part(p, middle) + part(q, middle)) / 2

    known = (F.col(total) > 0) & F.col(reference).isNotNull()
    return F.when(known, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(mine, reference, term), F.lit(0.0), lambda s, x: s + x)))).otherwise(0.0)


def quality_rules(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    max_class_distance: float = 0.18,
    max_word_distance: float = 0.19,
    slack: float = 1.0,
    min_chars: int = 200,
    min_words: int = 50,
    common_words: dict[str, str] | None = None,
) -> DataFrame:
    """(id, statistics, class_distance, word_distance, base_failed, kept) of every row.

    Null and empty texts have no words and fail the base rules.  The distances are 0 for documents
    shorter than ``min_chars`` word characters, or ``min_words`` words, and the word distance for
    languages without a word list; null languages share one reference.  Repeated rows are judged
    alike, and each is returned.  Other columns are ignored.
    """
    lists = {lang: [w.encode() for w in words.split()] for lang, words in (common_words or COMMON_WORDS).items()}
    rows = docs.select(col(id_column).alias("id"), col(text_column).alias("text"), col(lang_column).cast("string").alias("lang"))
    kept = Kept(rows.mapInArrow(sliced(_statistics(lists)), f"id {docs.schema[id_column].dataType.simpleString()}, lang string, {STATS}, classes array<long>, shares array<long>"), "statistics").df
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = kept.withColumn("base_failed", failed)
    widest = max(map(len, lists.values())) + 1
    sums = judged.where("NOT base_failed").groupBy("lang").agg(_sum_arrays("classes", CLASSES).alias("ref_classes"), F.filter(_sum_arrays("shares", widest), lambda x: x.isNotNull()).alias("ref_shares"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    sums = sums.select("lang", *[_shares(F.col(c), total(c)).alias(c) for c in ("ref_classes", "ref_shares")])
    references = Kept(sums, "references").df
    few = references.count() <= 10_000
    found = judged.alias("d").join(F.broadcast(references.alias("r")) if few else references.alias("r"), F.col("d.lang").eqNullSafe(F.col("r.lang")), "left")
    scored = found.select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.when(F.col("word_chars") >= min_chars, _distance("classes", "word_chars", "ref_classes")).otherwise(0.0).alias("class_distance"),
        F.when((F.col("n_words") >= min_words) & (F.size("shares") > 1), _distance("shares", "n_words", "ref_shares")).otherwise(0.0).alias("word_distance"),
        "base_failed",
    )
    noise = slack / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    passes = (F.col("class_distance") <= max_class_distance + noise) & (F.col("word_distance") <= max_word_distance + noise)
    return scored.withColumn("kept", ~F.col("base_failed") & passes)
