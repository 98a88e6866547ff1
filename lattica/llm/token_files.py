"""Token ids in files of directly addressable codes.

An id is cut into chunks of bits, lowest first.  Level 0 holds the first chunk of every id, level
1 the second chunk of those that have one, and so on; a bitmap per level tells which ids go on, and
a directory of ranks (bits set before every 512th) tells where: the chunk of id ``i`` on the next
level is number ``rank(i)``.  So any id is found with a few small reads and no block is decoded.
The widths of the chunks are those that make the file smallest, of whole bytes by default, which
take a tenth more room than free widths and are written and read several times as fast.

File: ``DACF``, header length, header (JSON), then for each level its packed chunks, its bitmap
and its directory, each at the offset that the header gives; documents' first ids and names last.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import files
from lattica.llm.common import Kept, col, new_path, sliced, tasks_for
from lattica.llm.tokens import encoder, stretches

_MAGIC = b"DACF"
RANK_EVERY = 512
#: Ids in a file, about.
FILE_IDS = 4 << 20


def chunk_widths(ids: np.ndarray, most: int = 3, unit: int = 8) -> list[int]:
    """Bits of each level's chunks, multiples of ``unit`` but for 24 at most, for the least bits in all."""
    bits = np.ceil(np.log2(ids.astype(np.float64) + 1)).astype(int).clip(1) if len(ids) else np.array([1])
    counts = np.bincount(bits)
    longer = counts.sum() - np.cumsum(counts)  # ids of more bits than the index
    top = min(-(-(len(counts) - 1) // unit) * unit, max(24, len(counts) - 1))
    longer = np.append(longer, np.zeros(top + 1, int))

    def cost(cuts: tuple[int, ...]) -> int:
        levels = [0, *cuts, top]
        return sum(int(longer[a]) * (b - a + (b < top)) for a, b in zip(levels, levels[1:]))

    best = min((c for k in range(most) for c in combinations(range(unit, top, unit), k)), key=cost)
    return np.diff([0, *best, top]).tolist()


def _container(width: int) -> str:
    return "<u2" if width <= 16 else "<u4"


def _pack_bits(values: np.ndarray, width: int) -> bytes:
    if width == 8:
        return values.astype(np.uint8).tobytes()
    out = []
    for at in range(0, len(values), 1 << 16):  # a multiple of 8, so that pieces meet at whole bytes
        part = values[at : at + (1 << 16)].astype(_container(width))
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        out.append(np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes())
    return b"".join(out)


def _unpack_bits(raw: bytes, width: int, first: int, n: int) -> np.ndarray:
    """``n`` numbers of ``width`` bits (at most 24) from the bit ``first``: each lies within four bytes."""
    at = first + width * np.arange(n, dtype=np.int64)
    padded = np.frombuffer(raw + b"\0\0\0\0", np.uint8)
    words = np.ndarray(len(padded) - 3, "<u4", padded.data, strides=(1,))
    return (words[at >> 3] >> (at & 7).astype(np.uint32)) & np.uint32((1 << width) - 1)


def encode(ids: np.ndarray, firsts: np.ndarray, names: list, unit: int = 8) -> list[bytes]:
    """The pieces of a file of ``ids`` (uint32), with each document's first id and name."""
    widths, parts, levels, offset = chunk_widths(ids, unit=unit), [], [], 0
    rest, n = ids, []

    def put(raw: bytes) -> int:
        nonlocal offset
        parts.append(raw)
        offset += len(raw)
        return offset - len(raw)

    for k, width in enumerate(widths):
        n.append(len(rest))
        level = {"n": len(rest), "width": width, "chunks": put(_pack_bits(rest & np.uint32((1 << width) - 1), width))}
        rest = rest >> np.uint32(width)
        if k + 1 < len(widths):
            more = rest > 0
            level["bitmap"] = put(np.packbits(more, bitorder="little").tobytes())
            padded = np.zeros(-(-len(more) // RANK_EVERY) * RANK_EVERY, bool)
            padded[: len(more)] = more
            sums = padded.reshape(-1, RANK_EVERY).sum(1)
            level["ranks"] = put((np.cumsum(sums) - sums).astype(np.uint32).tobytes())
            rest = rest[more]
        levels.append(level)
    head = {"ids": len(ids), "documents": len(names), "levels": levels, "firsts": put(firsts.astype(np.uint64).tobytes())}
    head["names"] = put(json.dumps(names).encode())
    head["end"] = offset
    raw = json.dumps(head).encode()
    return [_MAGIC, len(raw).to_bytes(4, "little"), raw, *parts]


class TokenFile:
    """Reads from a file by ``read_at(offset, length)``."""

    def __init__(self, read_at: Callable[[int, int], bytes]):
        magic = read_at(0, 8)
        if magic[:4] != _MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(magic[4:], "little")
        self.head = json.loads(read_at(8, n))
        self.read_at = lambda offset, length: read_at(8 + n + offset, length)

    def documents(self) -> tuple[list, np.ndarray]:
        """Names, and first ids with the number of all ids after them."""
        h = self.head
        firsts = np.frombuffer(self.read_at(h["firsts"], 8 * h["documents"]), np.uint64).astype(np.int64)
        return json.loads(self.read_at(h["names"], h["end"] - h["names"])), np.append(firsts, h["ids"])

    def get(self, first: int, n: int) -> np.ndarray:
        """Ids ``first`` to ``first + n``: the chunks of each level at the ranks that the directories give."""
        if first < 0 or n < 0 or first + n > self.head["ids"]:
            raise IndexError("no such ids")
        out, where, shift = np.zeros(n, np.uint32), np.arange(n), 0
        for level in self.head["levels"]:
            if not n:
                break
            width, bit = level["width"], first * level["width"]
            raw = self.read_at(level["chunks"] + bit // 8, -(-(bit % 8 + n * width) // 8))
            out[where] |= _unpack_bits(raw, width, bit % 8, n) << np.uint32(shift)
            shift += width
            if "bitmap" in level:
                start = first // RANK_EVERY * RANK_EVERY
                bits = np.unpackbits(np.frombuffer(self.read_at(level["bitmap"] + start // 8, -(-(first + n - start) // 8)), np.uint8), bitorder="little")
                before = int(np.frombuffer(self.read_at(level["ranks"] + 4 * (start // RANK_EVERY), 4), np.uint32)[0])
                more = bits[first - start : first - start + n].astype(bool)
                first, where = before + int(bits[: first - start].sum()), where[more]
                n = len(where)
        return out


def _write(path: str, words: bool, end: int, folder: str, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts, last = encoder(path, words, special).encode, end.to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        names, firsts, held, size, made = [], [], [], 0, 0

        def flush():
            nonlocal names, firsts, held, size, made
            ids = np.frombuffer(b"".join(held), np.uint32)
            row = [part, made, files.write(folder, ".dac", encode(ids, np.array(firsts), names)), len(names), len(ids)]
            names, firsts, held, size, made = [], [], [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "number", "path", "documents", "ids"])

        for batch in batches:
            texts, ids_of = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in stretches(texts):
                for name, ids in zip(ids_of[a:b], encode_texts(texts[a:b])):
                    names.append(name)
                    firsts.append(size)
                    held.append(ids + last)
                    size += len(ids) // 4 + 1
                    if size >= FILE_IDS:
                        yield flush()
        if names:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, words: bool = False, end: int = 2, id_column: str = "doc_id", text_column: str = "text", special: bool = False) -> DataFrame:
    """Writes all documents' ids in ascending id order; the manifest (path, documents, ids, start).

    A null or empty text has the ``end`` id only; null ids come first; rows that repeat an id follow
    each other.  ``start`` counts the ids in all files before.  Strings of the tokenizer's special
    tokens are ordinary text, unless ``special``.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "token-files")
    rows = docs.select(col(id_column).cast("long").alias("id"), col(text_column).cast("string").alias("text"))
    # Rows that repeat an id may lie in several ranges, in the order of a hash of their texts.
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(tasks_for(rows, "text"), *keys).sortWithinPartitions(*keys, "text")
    made = Kept(ordered.mapInArrow(sliced(_write(tokenizer, words, end, folder, special), encodes=True), "part long, number long, path string, documents long, ids long"), "token-manifest").df
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return made.select("path", "documents", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = files.Reader()
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            file = TokenFile(lambda offset, length, path=path: reader.read(path, offset, length))
            names, bounds = file.documents()
            for a in range(0, len(names), 256):
                b = min(a + 256, len(names))
                ids = file.get(int(bounds[a]), int(bounds[b] - bounds[a])).tobytes()
                cuts = 4 * (bounds[a : b + 1] - bounds[a])
                found = [ids[x:y] for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[a:b], pa.int64()), pa.array(bounds[a:b] + start, pa.int64()), pa.array(np.diff(bounds[a : b + 1]), pa.int64()), pa.array(found, pa.binary())], ["id", "start", "n_tokens", "ids"]
                )
    reader.close()


def read_tokens(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the files: its ids as little-endian 32-bit bytes.

    With ``digest`` the last column is their crc32 instead.
    """
    files_ = manifest.select("path", "start")
    tasks = files_.repartition(max(1, files_.count()))  # one file, of about FILE_IDS ids, a task
    if not digest:
        return tasks.mapInArrow(_read, "id long, start long, n_tokens long, ids binary")

    def summed(batches):
        for batch in _read(batches):
            crc = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], crc], ["id", "start", "n_tokens", "ids_crc32"])

    return tasks.mapInArrow(summed, "id long, start long, n_tokens long, ids_crc32 long")
