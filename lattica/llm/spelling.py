"""Spelling variants by an index of variable-length grams.

Two words are near if one code point inserted, deleted or replaced turns one into the other.

1. A dictionary of grams of QMIN to QMAX code points is counted over all words (a sentinel on either side) and pruned by frequency: a gram
   longer than QMIN stays if it makes up one in MOST_GRAMS of its length's occurrences.  So it is bounded, whatever the number of words.
2. A word is decomposed into variable grams: from each place the longest gram of the dictionary, else QMIN code points;
   grams inside an earlier one are left out.
3. For each place that may be edited, the grams that it can affect are told: those that look at the place when they are chosen, and
   those that a gram chosen anew before them could swallow.  All others survive in every near word, at the same distance from its
   start (if left of the edit) or from its end (if right of it).  So each word has a bound on its affected grams at each place.
4. Every word is listed under each of its grams, by distance from the start and from the end, and by its length.  A word merges few lists:
   of the grams that survive an edit the rarest, with as few lists as hit every edit.  A word of QMAX * 2 - 2
   code points at least has a survivor at every edit, so a near word is always met.
5. Pairs met in a list are verified by their edit distance in the join's condition; no other pair is written.
   Lists of more than LIST_ROWS words are split into shares, each of which meets every word that asks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import BROADCAST_KEYS, Kept, col, sliced

QMIN, QMAX = 2, 4
#: Grams of each length that the dictionary holds at most.
MOST_GRAMS = 20_000
#: The least length of a word, in code points, with a surviving gram at every edit.
LEAST_LENGTH = 2 * QMAX - 2
#: Words of a share of a list, about.
LIST_ROWS = 20_000
#: Distinct words that a task counts before it sends them on, and code points of a text that are split at once.
_HELD, _STRETCH = 200_000, 1 << 20

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")


def _runs(text: str) -> Iterator[Counter]:
    """Maximal runs of letters, A-Z in lower case, with their counts, a stretch of the text at a time."""
    at = 0
    while at < len(text):
        stop = _OTHER.search(text, at + _STRETCH)
        end = stop.start() if stop else len(text)
        yield Counter(_RUN.findall(text[at:end].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
        at = end


def misprinted(name: str, word: str, one_in: int) -> str:
    """The word, without one code point if the CRC-32 of ``name:word`` is a multiple of ``one_in``."""
    h = zlib.crc32(f"{name}:{word}".encode())
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _count(least: int, one_in: int):
    def table(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                name = name.as_py() or ""
                for found in _runs(text.as_py() or ""):
                    for word, n in found.items():
                        if len(word) < least:
                            continue
                        word = misprinted(name, word, one_in) if one_in else word
                        if len(word) >= least:
                            held[word] += n
                    if len(held) >= _HELD:
                        yield table(held)
                        held.clear()
        if held:
            yield table(held)

    return run


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH, least_count: int = 5, one_in: int = 0) -> DataFrame:
    """(word, n) of the words of all texts with at least ``least_length`` code points and ``least_count`` occurrences.

    A word is a maximal run of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z in lower case.  With ``one_in`` the CRC-32 of ``id:word`` decides
    which documents misprint a word (see ``misprinted``).  Null texts have no words, a null id is the empty text in the checksum,
    repeated rows count again, and other columns are ignored.
    """
    rows = docs.select(col(id_column).cast("string"), col(text_column).cast("string"))
    counted = rows.mapInArrow(sliced(_count(least_length, one_in)), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Grams:
    """The dictionary: occurrences of each gram without those of longer grams that start with it."""

    def __init__(self, counts: dict[str, int]):
        self.rest = dict(counts)
        for gram, n in counts.items():
            if gram[:-1] in self.rest:
                self.rest[gram[:-1]] -= n
        self.long = {g for g in counts if len(g) > QMIN}
        self.starts = {g[:k] for g in self.long for k in range(1, len(g) + 1)}
        self.ends = {g[k:] for g in self.long for k in range(1, len(g))}

    def decompose(self, x: str) -> list[tuple[int, int, int]]:
        """(start, end, seen) of each variable gram: an edit at ``seen`` or later leaves it as it is, if it is right of it."""
        out, top, seen = [], 0, 0
        for p in range(len(x) - QMIN + 1):
            size, k = QMIN, 1
            while k <= QMAX and p + k <= len(x) and x[p : p + k] in self.starts:
                if x[p : p + k] in self.long:
                    size = k
                k += 1
            seen = max(seen, p + max(QMIN, min(k, QMAX)))
            if p + size > top:
                top = p + size
                out.append((p, top, seen))
        return out

    def swallowed(self, x: str, r: int) -> int:
        """Grams that start at ``r`` or later and end here or earlier may be inside a gram that begins before ``r``, if that part of ``x`` changes."""
        for end in range(min(r + QMAX - 1, len(x)), r + QMIN - 1, -1):
            if x[r:end] in self.ends:
                return end
        return r + QMIN - 1

    def lists(self, x: str) -> list[str]:
        """The lists that name the padded word ``x``."""
        return [k for p, end, _ in self.decompose(x) for k in (f"<{p}:{x[p:end]}", f">{len(x) - p}:{x[p:end]}")]

    def survivors(self, x: str) -> list[list[tuple[int, str]]]:
        """(occurrences, list) of the grams that survive, for each place of ``x`` that is replaced or deleted."""
        grams, out = self.decompose(x), []
        for i in range(1, len(x) - 1):
            beyond = self.swallowed(x, i + 1)
            left = [(self.rest.get(x[p:end], 0), f"<{p}:{x[p:end]}") for p, end, seen in grams if seen <= i]
            out.append(left + [(self.rest.get(x[p:end], 0), f">{len(x) - p}:{x[p:end]}") for p, end, _ in grams if p > i and end > beyond])
        return out

    def asked(self, x: str) -> list[str]:
        """Few lists, of rare grams, of which every word that lacks or replaces one code point of ``x`` is in one at least."""
        chosen: list[str] = []
        for kept in sorted(self.survivors(x), key=len):
            if not kept:
                raise ValueError(f"words of fewer than {LEAST_LENGTH} code points have no bound")
            if not any(name in chosen for _, name in kept):
                chosen.append(min(kept)[1])
        return chosen


def _padded(word: str) -> str:
    return f"\x02{word}\x03"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for word in batch.column(0).to_pylist():
            x = _padded(word)
            for q in range(QMIN, QMAX + 1):
                found.update(x[p : p + q] for p in range(len(x) - q + 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.int64())], ["gram", "n"])


def dictionary(words: DataFrame) -> Grams:
    """The frequency-pruned dictionary of a table of words: at most MOST_GRAMS of each length, by the arithmetic of the threshold."""
    counted = Kept(words.select("word").mapInArrow(sliced(_occurrences), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams").df
    totals = counted.groupBy(F.length("gram").alias("q")).agg(F.sum("n").alias("total"))  # a row a length
    frequent = counted.join(F.broadcast(totals), F.length("gram") == F.col("q")).where(F.col("n") * MOST_GRAMS >= F.col("total"))
    return Grams({r["gram"]: r["n"] for r in frequent.select("gram", "n").collect()})


def _listed(grams: Grams, names: Callable[[Grams, str], list[tuple[str, int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = defaultdict(list)
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = _padded(word)
                for name, length in names(grams, x):
                    out["list"].append(f"{length}{name}")
                    out["word"].append(word)
                    out["n"].append(n)
            yield pa.RecordBatch.from_arrays([pa.array(out["list"], pa.string()), pa.array(out["word"], pa.string()), pa.array(out["n"], pa.int64())], ["list", "word", "n"])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of all pairs of ``words`` (word, n) that one edit parts, each once.

    Words have LEAST_LENGTH code points at least (fewer are an error) and are distinct.
    """
    grams = dictionary(words)
    schema = "list string, word string, n long"
    index = words.mapInArrow(sliced(_listed(grams, lambda g, x: [(name, len(x)) for name in g.lists(x)])), schema)
    asks = words.mapInArrow(sliced(_listed(grams, lambda g, x: [(name, n) for name in g.asked(x) for n in (len(x), len(x) - 1)])), schema)
    index = Kept(index.select(F.xxhash64("list").alias("list"), F.col("word").alias("b"), F.col("n").alias("n_b")), "lists").df
    asks = asks.select(F.xxhash64("list").alias("list"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    long = Kept(index.groupBy("list").agg(F.ceil(F.count("*") / LIST_ROWS).alias("shares")).where("shares > 1"), "long").df
    # Long lists are fewer than the postings by a factor of LIST_ROWS; beyond the bound of a broadcast the join is shuffled.
    long = F.broadcast(long) if long.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else long
    shares = F.coalesce("shares", F.lit(1))
    index = index.join(long, "list", "left").select("list", F.pmod(F.xxhash64("b"), shares).alias("share"), "b", "n_b")
    asks = asks.join(long, "list", "left").select("list", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"), "a", "n_a")
    shorter = F.length("b") < F.length("a")
    met = asks.join(index, ["list", "share"]).where((shorter | (F.col("b") < F.col("a"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of ``words`` (word, n).

    ``n_near`` counts the near words.  ``form`` is the near word of the largest n (of equals the first by code points), if that is ``ratio`` times the word's
    own at least, and ``form_n`` its n; else both are null.  ``root`` is the last word reached by forms, the word itself if it has none.
    """
    words = Kept(words.select("word", "n"), "words").df
    pairs = Kept(near_pairs(words), "near").df
    both = pairs.union(pairs.select("b", "n_b", "a", "n_a"))
    fits = F.col("n_b") >= ratio * F.col("n_a")
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.when(fits, F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("form")))).alias("best"))
    found = Kept(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n")), "forms").df
    forms = found.where("form IS NOT NULL").select("word", "form")
    # Each form is ``ratio`` times as frequent, so chains are short: a round a link.
    now, done = forms.select("word", F.col("form").alias("root")), None
    following = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    while True:
        moved = Kept(now.join(following, "root", "left").select("word", "root", "next"), "roots").df
        ended = moved.where("next IS NULL").select("word", "root")
        done = ended if done is None else done.union(ended)
        now = moved.where("next IS NOT NULL").select("word", F.col("next").alias("root"))
        if now.isEmpty():
            break
    return found.join(done, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
