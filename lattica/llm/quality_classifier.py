"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of 8 bytes move over the text by 4 and are pooled (mean and
maximum) over 64 bytes.  A chunk is 512 bytes, and chunks overlap by half and cover the whole
document; its features are the mean and the deviation of its pooled filters, so that both strange
characters and monotony show.  A hidden layer follows, its units are max-pooled over all chunks of
the document, and a logistic unit combines them into one probability.  Only the text is an input.

The network is trained on the driver, from a sample of labelled rows of bounded number and length
(``Training``); every row is scored where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lattica.llm.common import col, sliced, whole_row

EMBEDDING, FILTERS, HIDDEN = 8, 24, 32
STEP, SUB_BLOCK, GROUP = 4, 64, 256
#: Bytes of padded text that go through the network at once.
_AT_ONCE = 1 << 18
_EPS = 1e-4


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the training: at most ``per_class`` texts of each label, of at most ``max_bytes`` bytes."""

    per_class: int = 1500
    max_bytes: int = 16_384
    epochs: int = 7
    least_steps: int = 700
    batch: int = 24
    rate: float = 4e-3
    seed: int = 7


def _lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte codes with 256 for padding, groups of each text, real bytes of each sub-block)."""
    groups = np.array([max(2, -(-len(t) // GROUP)) for t in texts])
    codes = np.full(int(groups.sum()) * GROUP, 256, np.int16)
    real = np.zeros(len(codes) // SUB_BLOCK, np.float32)
    at = 0
    for text, n in zip(texts, groups):
        codes[at : at + len(text)] = np.frombuffer(text, np.uint8)
        real[at // SUB_BLOCK : at // SUB_BLOCK + -(-len(text) // SUB_BLOCK)] = 1
        at += int(n) * GROUP
    return codes, groups, real


class ByteConv:
    """The network; ``params`` holds all that is learned."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        features = 4 * FILTERS
        self.params = {
            "embed": r.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32),
            "filters": r.normal(0, 0.18, (2 * STEP * EMBEDDING, FILTERS)).astype(np.float32),
            "offset": np.zeros(FILTERS, np.float32),
            "hidden": r.normal(0, 0.12, (features, HIDDEN)).astype(np.float32),
            "hidden_offset": np.zeros(HIDDEN, np.float32),
            "out": r.normal(0, 0.2, HIDDEN).astype(np.float32),
            "out_offset": np.zeros(1, np.float32),
        }
        self.params["embed"][256] = 0

    def forward(self, texts: list[bytes], keep: bool = False):
        p = self.params
        codes, groups, real = _lay_out(texts)
        firsts = np.cumsum(groups) - groups
        rows = p["embed"][codes].reshape(-1, STEP * EMBEDDING)
        after = np.empty_like(rows)
        after[:-1] = rows[1:]
        after[(firsts + groups) * (GROUP // STEP) - 1] = 0  # no window reaches into the next text
        half = STEP * EMBEDDING
        conv = rows @ p["filters"][:half] + after @ p["filters"][half:] + p["offset"]
        np.maximum(conv, 0, out=conv)
        sub = conv.reshape(-1, SUB_BLOCK // STEP, FILTERS)
        pooled = np.concatenate([sub.mean(1), sub.max(1)], axis=1)
        weighed = pooled * real[:, None]
        per = GROUP // SUB_BLOCK
        sums, squares, counts = (x.reshape(-1, per, *x.shape[1:]).sum(1) for x in (weighed, weighed * pooled, real))
        # A chunk is a group and the next one of the same text.
        first_of_chunk = np.concatenate([np.arange(a, a + n - 1) for a, n in zip(firsts, groups)])
        n = np.maximum(counts[first_of_chunk] + counts[first_of_chunk + 1], 1)[:, None]
        mean = (sums[first_of_chunk] + sums[first_of_chunk + 1]) / n
        spread = np.sqrt(np.maximum((squares[first_of_chunk] + squares[first_of_chunk + 1]) / n - mean**2, 0) + _EPS)
        chunk = np.concatenate([mean, spread], axis=1)
        hidden = chunk @ p["hidden"] + p["hidden_offset"]
        active = np.maximum(hidden, 0)
        begins = np.cumsum(groups - 1) - (groups - 1)
        best = np.maximum.reduceat(active, begins, axis=0)
        score = 1 / (1 + np.exp(-np.clip(best @ p["out"] + p["out_offset"], -30, 30)))
        if not keep:
            return score
        return score, (codes, groups, real, rows, after, conv, sub, pooled, first_of_chunk, n, mean, spread, chunk, active, begins, best)

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the texts and its gradient."""
        p = self.params
        score, (codes, groups, real, rows, after, conv, sub, pooled, first, n, mean, spread, chunk, active, begins, best) = self.forward(texts, keep=True)
        loss = -np.mean(np.where(labels == 1, np.log(score + 1e-9), np.log(1 - score + 1e-9)))
        d_logit = ((score - labels) / len(labels)).astype(np.float32)
        g = {"out": best.T @ d_logit, "out_offset": d_logit.sum(keepdims=True)}
        owner = np.repeat(np.arange(len(texts)), groups - 1)
        is_best = (active == best[owner]) & (active > 0)
        d_hidden = np.where(is_best, (d_logit[:, None] * p["out"])[owner], 0).astype(np.float32)
        g["hidden"], g["hidden_offset"] = chunk.T @ d_hidden, d_hidden.sum(0)
        d_chunk = d_hidden @ p["hidden"].T
        width = 2 * FILTERS
        d_spread = d_chunk[:, width:] / (2 * spread)
        d_mean = d_chunk[:, :width] - 2 * mean * d_spread
        d_sums, d_squares = np.zeros((len(real) * SUB_BLOCK // GROUP, width), np.float32), np.zeros((len(real) * SUB_BLOCK // GROUP, width), np.float32)
        for k in (0, 1):  # a group lies in two chunks; within one k the indices are distinct
            d_sums[first + k] += d_mean / n
            d_squares[first + k] += d_spread / n
        per = GROUP // SUB_BLOCK
        d_pooled = (np.repeat(d_sums, per, axis=0) + 2 * pooled * np.repeat(d_squares, per, axis=0)) * real[:, None]
        d_sub = np.repeat(d_pooled[:, None, :FILTERS] / sub.shape[1], sub.shape[1], axis=1)
        d_sub += np.where(sub == pooled[:, None, FILTERS:], d_pooled[:, None, FILTERS:], 0)
        d_conv = d_sub.reshape(-1, FILTERS) * (conv > 0)
        half = STEP * EMBEDDING
        g["filters"] = np.concatenate([rows.T @ d_conv, after.T @ d_conv])
        g["offset"] = d_conv.sum(0)
        d_rows = d_conv @ p["filters"][:half].T
        back = d_conv @ p["filters"][half:].T
        back[np.cumsum(groups) * (GROUP // STEP) - 1] = 0
        d_rows[1:] += back[:-1]
        d_rows = d_rows.reshape(-1, EMBEDDING)
        g["embed"] = np.stack([np.bincount(codes, weights=d_rows[:, e], minlength=257) for e in range(EMBEDDING)], axis=1).astype(np.float32)
        g["embed"][256] = 0
        return float(loss), g

    def fit(self, texts: list[bytes], labels: np.ndarray, training: Training) -> ByteConv:
        """Adam over shuffled batches, the same for the same rows."""
        r = np.random.default_rng(training.seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.params.items()} for _ in range(2))
        a_round = -(-len(texts) // training.batch)
        rounds = max(training.epochs, -(-training.least_steps // a_round))
        step, total = 0, rounds * a_round
        for _ in range(rounds):
            order = r.permutation(len(texts))
            for at in range(0, len(order), training.batch):
                some = order[at : at + training.batch]
                _, g = self.gradients([texts[i] for i in some], labels[some])
                step += 1
                rate = training.rate * min(1.0, step / 20) * (1 - 0.9 * step / total)
                for k, v in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.params[k] = (self.params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return self

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Scores of whole texts of any length; 0 for null and empty ones."""
        out = np.zeros(len(texts))
        order = [i for i, t in enumerate(texts) if t]
        at = 0
        while at < len(order):
            some, size = [], 0
            while at < len(order) and (not some or size + len(texts[order[at]]) <= _AT_ONCE):
                size += len(texts[order[at]]) + 2 * GROUP
                some.append(order[at])
                at += 1
            out[some] = self._long(texts[some[0]]) if size > 2 * _AT_ONCE else self.forward([texts[i] for i in some])
        return out

    def _long(self, text: bytes) -> np.ndarray:
        """A text beyond the usual size goes in stretches, whose chunks' maxima are joined.

        A stretch reads two groups on, and leaves the chunk of those to the next one, so that every
        chunk is seen as in the whole text.
        """
        p, best, at = self.params, 0, 0
        while True:
            last = at + _AT_ONCE + 2 * GROUP >= len(text)
            *_, active, _, _ = self.forward([text[at : at + _AT_ONCE + 2 * GROUP]], keep=True)[1]
            best = np.maximum(best, (active if last else active[:-1]).max(0))
            if last:
                return 1 / (1 + np.exp(-np.clip(best @ p["out"] + p["out_offset"], -30, 30)))
            at += _AT_ONCE


def held_out(id_column) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, training: Training = Training(), id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> ByteConv:
    """A network fitted on rows that aren't held out, in order of a hash of their id.

    Null ids teach nothing, nor do ids with both labels.  Each text that has an id is a row of its own;
    without any, the network is as it began.
    """
    known = labels.select(col(id_column).alias("id"), col(label_column).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    known = known.where(~held_out("id")).groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("id", "label")
    # A hash order is a sample; five times the number leaves enough texts within the length, and is small enough to be broadcast.
    asked = [known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(5 * training.per_class) for label in (0, 1)]
    rows = docs.select(col(id_column).alias("id"), col(text_column).cast("binary").alias("text")).join(F.broadcast(asked[0].union(asked[1])), "id")
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", "text")
    rows = rows.where(F.octet_length("text").between(1, training.max_bytes)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= training.per_class)
    texts = [(bytes(r["text"]), r["label"]) for r in sorted(rows.select("text", "label", "place").collect(), key=lambda r: (r["label"], r["place"]))]
    model = ByteConv(training.seed)
    return model.fit([t for t, _ in texts], np.array([y for _, y in texts]), training) if texts else model


def _score(model: ByteConv, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(batch.column(0).field(text).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc", "score"])

    return run


def score(docs: DataFrame, model: ByteConv, text_column: str = "text") -> DataFrame:
    """(doc, score): all columns of each row as a struct, and the probability that it is good.

    Null and empty texts score 0.  Rows with equal texts score alike, whatever their ids, null ones included.
    """
    # Rows hold each text once, since a task has a batch of them on the JVM's side and one on Python's.
    rows, names = docs.select(whole_row(docs).alias("doc")), docs.columns
    at = names.index(text_column) if text_column in names else [c.lower() for c in names].index(text_column.lower())
    return rows.mapInArrow(sliced(_score(model, at)), StructType([rows.schema["doc"], StructField("score", DoubleType())]))
