"""Vectorised word splitting and hashing of UTF-8 text blocks.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``.  A whole block of
documents is hashed at once: prefix sums of ``byte * P**i`` modulo 2**64 give every word's
polynomial hash by two look-ups, and a finalizer mixes the bits.  Nothing depends on the process,
so hashes made by different executors (or by a retried task) agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; a longer document forms a block of its own.
BLOCK_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C55)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64 (shift, multiply, twice)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        tables = []
        for base in (_P, _P_INV):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        if size > 4 * BLOCK_BYTES:
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def hash_words(data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words in a uint8 array."""
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    words = (sums[ends] - sums[starts]) * down[starts]
    return starts, ends, mix64(words + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes; the word order matters."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix64((sums[width:] - sums[:n]) * down[:n] + np.uint64(width))


class Block:
    """Consecutive documents of a record batch, with their bytes laid end to end, a blank between."""

    def __init__(self, first: int, texts: list[bytes | None]):
        self.first, self.n = first, len(texts)
        self.data = np.frombuffer(b" ".join(t or b"" for t in texts), np.uint8)
        lengths = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths + 1)])  # of each document's first byte

    def words(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of the block, and each document's first word in them (n + 1 entries)."""
        starts, _, hashes = hash_words(self.data, lower)
        return hashes, np.searchsorted(starts, self.offsets)


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of at most ``limit`` bytes, or of one document."""
    first, held, size = 0, [], 0
    for i, text in enumerate(column.cast(pa.binary())):
        text = text.as_py()
        if held and size + len(text or b"") > limit:
            yield Block(first, held)
            first, held, size = i, [], 0
        held.append(text)
        size += len(text or b"") + 1
    if held:
        yield Block(first, held)


def shingle_sets(block: Block, width: int) -> Iterator[np.ndarray]:
    """Each document's distinct ``width``-word shingles as sorted hashes.

    Words are lower-cased (A-Z).  A document of fewer words is one shingle, of all its words; one
    without words or text has the empty set.
    """
    words, firsts = block.words(lower=True)
    windows = hash_windows(words, width)
    for i in range(block.n):
        a, b = firsts[i], firsts[i + 1]
        if b - a >= width:
            yield np.unique(windows[a : b - width + 1])
        elif b > a:
            yield hash_windows(words[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)
