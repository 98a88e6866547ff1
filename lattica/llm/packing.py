"""Packing by vector bin packing.

A sequence has room for so many tokens, segments and loss-bearing tokens at once.  Of the waiting
pieces that fit, the one with the greatest dot product of its demand and the room left (both in
shares of the limits, weighed by the mean demand) is placed; when none fits, a piece is cut to fill
the sequence, and its rest waits on.  Each task packs its own partition in a stream, with a bounded
number of waiting pieces, so nothing is shuffled and padding arises in each task's last sequence
only (or where the other limits forbid more).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import col, sliced
from lattica.llm.tokens import encoder, stretches


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048
    #: Pieces that wait in a task.
    waiting: int = 512

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss, self.waiting) < 1:
            raise ValueError("every limit has to be 1 at least")


class Packer:
    """Places pieces of ``ids``; of a document's ids, those before ``silent`` bear no loss."""

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.sequence = limits, first_sequence
        self.room = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
        self.pieces: list[tuple] = []  # (document, start, ids, silent, document's tokens)
        self.placed: list[tuple] = []

    def add(self, document, ids: bytes, silent: int = 0) -> None:
        total, start = len(ids) // 4, 0
        # Whole sequences of a long document need no choice.
        while total - start >= self.limits.tokens and self.loss(start, self.limits.tokens, silent) <= self.limits.loss:
            self.place(document, start, ids[4 * start : 4 * (start + self.limits.tokens)], total, self.sequence, 0)
            self.sequence += 1
            start += self.limits.tokens
        if start < total:
            self.pieces.append((document, start, ids[4 * start :], silent, total))
        if len(self.pieces) >= self.limits.waiting:
            self.pack(self.limits.waiting // 4)

    @staticmethod
    def loss(start: int, length: int, silent: int) -> int:
        return max(0, start + length - max(start, silent))

    def place(self, document, start: int, ids: bytes, total: int, sequence: int, offset: int) -> None:
        self.placed.append((document, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))

    def demand(self, piece: tuple) -> tuple[int, int, int]:
        return len(piece[2]) // 4, 1, self.loss(piece[1], len(piece[2]) // 4, piece[3])

    def pack(self, leave: int) -> None:
        """Fill sequences until at most ``leave`` pieces wait."""
        pieces = self.pieces
        demand = np.array([self.demand(p) for p in pieces], np.float64).reshape(-1, 3) / self.room
        waits = np.ones(len(pieces), bool)
        left = len(pieces)
        while left > leave:
            weights = demand[waits].mean(0)
            room, offset = np.ones(3), 0
            while left:
                fits = (demand <= room + 1e-12).all(1) & waits
                if fits.any():
                    i = int(np.argmax(np.where(fits, demand @ (weights * room), -1)))
                    document, start, ids, silent, total = pieces[i]
                    waits[i] = False
                    left -= 1
                else:
                    i = int(np.argmax(np.where(waits, demand[:, 0], -1)))
                    document, start, ids, silent, total = pieces[i]
                    tokens, segments, loss = np.rint(room * self.room).astype(int)
                    n = min(int(tokens), len(ids) // 4 - 1, int(loss) + max(0, silent - start))
                    if segments < 1 or n < 1:
                        break
                    pieces[i] = (document, start + n, ids[4 * n :], silent, total)
                    ids = ids[: 4 * n]
                    demand[i] = np.array(self.demand(pieces[i])) / self.room
                self.place(document, start, ids, total, self.sequence, offset)
                offset += len(ids) // 4
                room = room - np.array(self.demand((document, start, ids, silent, total))) / self.room
                if room[0] < 1e-9 or room[1] < 1e-9:
                    break
            self.sequence += 1
        self.pieces = [p for p, w in zip(pieces, waits) if w]

    def take(self) -> list[tuple]:
        out, self.placed = self.placed, []
        return out


_NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack(path: str, words: bool, end: int, limits: Limits, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(path, words, special).encode, end.to_bytes(4, "little")
        packer = Packer(limits, TaskContext.get().partitionId() << 33)
        kind = pa.int64()

        def out():
            columns = list(zip(*packer.take())) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind] + [pa.int64()] * 6)], _NAMES)

        for batch in batches:
            kind = batch.column(0).type
            names, silent = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = batch.column(1).to_pylist()
            for a, b in stretches(texts):
                for name, ids, quiet in zip(names[a:b], encode(texts[a:b]), silent[a:b]):
                    packer.add(name, ids + last, quiet or 0)
                if packer.placed:
                    yield out()
        packer.pack(0)
        if packer.placed:
            yield out()

    return run


def pack(docs: DataFrame, tokenizer: str, words: bool = True, end: int = 1, limits: Limits = Limits(), id_column: str = "doc_id", text_column: str = "text", silent_column: str | None = None, special: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    A document's ids are those of its whole text and ``end``; a null or empty text has ``end`` only.
    Strings of the tokenizer's special tokens are ordinary text, unless ``special``.
    The first ``silent_column`` ids of a document bear no loss (null or no column: all bear loss).
    Every id lies in exactly one piece.  Repeated rows and null ids are packed as they come.  Other
    columns are ignored.
    """
    silent = col(silent_column).cast("long") if silent_column else F.lit(None).cast("long")
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(col(id_column).alias("id"), col(text_column).cast("string").alias("text"), silent.alias("silent"))
    done = rows.mapInArrow(sliced(_pack(tokenizer, words, end, limits, special), encodes=True), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return done.withColumnRenamed("id", id_column)
