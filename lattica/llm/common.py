"""What the operators of this subpackage share: tables kept between jobs, bounded broadcasts."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.plans.tables import Kept, clear, new_path

__all__ = ["BROADCAST_KEYS", "PIECE_ROWS", "Kept", "clear", "col", "filter_by", "new_path", "quoted", "sliced", "tasks_for", "whole_row"]

#: Rows of 8-byte keys that may be broadcast; beyond it the same join is shuffled.
BROADCAST_KEYS = 1_000_000
#: Rows of a piece of a record batch that a Python worker handles at once.
PIECE_ROWS = 2000


#: Bytes of texts that one task of an exchange takes, about.
TASK_BYTES = 16 << 20


def tasks_for(df: DataFrame, text: str) -> int:
    """How many tasks the texts of ``df`` are dealt to: a number that follows from their bytes, not from the session."""
    return max(1, -(-(df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // TASK_BYTES))


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it holds."""
    return f"`{name.replace('`', '``')}`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, in which none can clash."""
    return F.struct(*[col(c).alias(c) for c in df.columns])


def let_go() -> None:
    """Free the encoders, with what they have learned, that earlier tasks left in this worker, and give the memory back."""
    tokens = sys.modules.get("lattica.llm.tokens")
    if tokens and tokens.encoder.cache_info().currsize:
        tokens.encoder.cache_clear()
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what is freed
            trim(0)


def sliced(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], encodes: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` on pieces of at most PIECE_ROWS rows; Spark bounds the batches themselves by their bytes.

    Only tasks that encode keep the worker's encoders, and no task keeps Arrow's unused memory: a
    worker that waits for its next task counts beside the others.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            let_go()
        yield from run(b.slice(at, PIECE_ROWS) for b in batches for at in range(0, b.num_rows, PIECE_ROWS))
        pa.default_memory_pool().release_unused()

    return over


def filter_by(df: DataFrame, keys: DataFrame, column: str | list[str], anti: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``column`` (or columns) is (or with ``anti`` isn't) in the kept table ``keys``.

    The keys are broadcast only if they number at most BROADCAST_KEYS, else the join is shuffled.
    """
    how = "left_anti" if anti else "left_semi"
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if small else keys, column, how)
