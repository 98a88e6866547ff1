"""Substring dedup by fixed-block anchors.

A window of ``width`` words that starts at two places of the corpus holds, at either place, a whole
reference block: blocks are the non-overlapping runs of ``(width + 1) // 2`` words that start at
multiples of that length.  So

1. every block is indexed, and every rolling window of a block's length probes the index;
2. each hit is extended: the windows of ``width`` words around it are the only ones that can
   repeat; those that do start at two places (they are counted by 128-bit hash) overlap into the
   maximal exact repeats;
3. the words under repeated windows are removed.

Probes are exchanged packed: a task hashes a stretch of documents, drops what repeats within the
stretch (which it then knows already), and sends each partition its share of the rest as one row of
seven to nine bytes a probe (at 30 GB and at 100 TB).  Partitions are bounded in number and stretches grow with them, so rows stay
long at any size of the corpus; beyond that bound a partition takes several hash ranges, to which it
deals its probes by a sort of its own, and answers one range after the other in bounded memory.
However often a passage occurs, one stretch sends it once, so a frequent
passage loads a task with one probe a stretch.  A stretch is named by its contents, so tasks run
again after a lost executor give the same addresses.  Probes of blocks have 32 bits, since a false
hit only costs work; what decides, the windows' hashes and the rows' names, has 128.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lattica.llm.common import Kept, col, filter_by, sliced, whole_row
from lattica.llm.words import BLOCK_BYTES, blocks, hash_windows, mix64

#: Bytes of text whose probes meet in one group; partitions that the groups are dealt to at most.
PART_BYTES, MOST_PARTITIONS = 10 << 20, 20_000
#: Bytes of a stretch for each partition that it sends to, within its least and largest size.
SHARE_BYTES, LARGEST_STRETCH = 420, 4 * BLOCK_BYTES
#: Bytes of packed probes that a task deals to its hash ranges at once.
DEALT_BYTES = 4 << 20
_PROBES, _MAP, _FOUND = 0, 1, 2
_ROW = "part long, kind int, batch long, payload binary"
_NAMES = ["part", "kind", "batch", "payload"]
_ANSWER = "batch long, kind int, payload binary"
_ANSWER_NAMES = ["batch", "kind", "payload"]
#: The two halves of a row's name.
_KEY = ["key", "key2"]


class Deal(NamedTuple):
    """How probes are dealt: to ``shares`` partitions of ``ranges`` hash ranges each, from stretches of about ``stretch`` bytes."""

    shares: int
    ranges: int
    stretch: int


def deal(size: int) -> Deal:
    """The deal for ``size`` bytes of text."""
    groups = max(1, -(-size // PART_BYTES))
    shares = min(groups, MOST_PARTITIONS)
    return Deal(shares, -(-groups // shares), min(LARGEST_STRETCH, max(BLOCK_BYTES, SHARE_BYTES * shares)))


def _planes(x: np.ndarray) -> bytes:
    """Numbers as byte planes: the upper ones are mostly zero and compress away."""
    return np.ascontiguousarray(x[:, None].view(np.uint8).T).tobytes()


def _unplaned(raw: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def _pack(hashes: list[np.ndarray], where: np.ndarray, ranges: np.ndarray, flags: np.ndarray) -> bytes:
    """What one stretch sends to one partition, by ascending places."""
    deltas = np.diff(where, prepend=np.uint32(0)).astype(np.uint32)
    return np.uint32(len(where)).tobytes() + b"".join(h.tobytes() for h in hashes) + _planes(deltas) + _planes(ranges.astype(np.uint16)) + np.packbits(flags).tobytes()


def _unpack(payload: bytes, kind: type, halves: int) -> tuple[np.ndarray, ...]:
    """(each half of the hashes, places, ranges, flags)."""
    n, wide = int(np.frombuffer(payload, np.uint32, 1)[0]), np.dtype(kind).itemsize
    raw = np.frombuffer(payload, np.uint8, offset=4)
    hashes = [np.frombuffer(payload, kind, n, offset=4 + k * n * wide) for k in range(halves)]
    at = n * wide * halves
    places = np.cumsum(_unplaned(raw[at : at + 4 * n], np.uint32), dtype=np.uint32)
    return *hashes, places, _unplaned(raw[at + 4 * n : at + 6 * n], np.uint16), np.unpackbits(raw[at + 6 * n :], count=n).astype(bool)


def _pack_run(batches: np.ndarray, counts: np.ndarray, hashes: list[np.ndarray], where: np.ndarray, flags: np.ndarray) -> bytes:
    """Probes of one hash range from several stretches: ``counts`` of them from each of ``batches``."""
    head = np.array([len(batches), len(where)], np.uint32).tobytes()
    return head + batches.astype(np.int64).tobytes() + counts.astype(np.uint32).tobytes() + b"".join(h.tobytes() for h in hashes) + where.tobytes() + np.packbits(flags).tobytes()


def _unpack_run(payload: bytes, kind: type, halves: int) -> tuple[np.ndarray, ...]:
    """(batch of each probe, each half of the hashes, places, flags)."""
    many, n = (int(x) for x in np.frombuffer(payload, np.uint32, 2))
    wide, at = np.dtype(kind).itemsize, 8 + 12 * many
    batch = np.repeat(np.frombuffer(payload, np.int64, many, offset=8), np.frombuffer(payload, np.uint32, many, offset=8 + 8 * many))
    hashes = [np.frombuffer(payload, kind, n, offset=at + k * n * wide) for k in range(halves)]
    at += n * wide * halves
    return batch, *hashes, np.frombuffer(payload, np.uint32, n, offset=at), np.unpackbits(np.frombuffer(payload, np.uint8, offset=at + 4 * n), count=n).astype(bool)


def _runs(rows: list[tuple[int, bytes]], kind: type, halves: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(range, kind, 0, payload): these stretches' probes, dealt to the hash ranges."""
    got = [_unpack(payload, kind, halves) for _, payload in rows]
    *hashes, where, ranges, flags = (np.concatenate(x) for x in zip(*got))
    batch = np.repeat(np.array([b for b, _ in rows], np.int64), [len(g[-1]) for g in got])
    order = np.argsort(ranges, kind="stable")
    batch, hashes, where, ranges, flags = batch[order], [h[order] for h in hashes], where[order], ranges[order], flags[order]
    cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1], True])
    for a, b in zip(cuts[:-1], cuts[1:]):
        mine = batch[a:b]
        firsts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        yield int(ranges[a]), _PROBES, 0, _pack_run(mine[firsts], np.diff(np.r_[firsts, b - a]), [h[a:b] for h in hashes], where[a:b], flags[a:b])


def _groups(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins): equal hashes stand together in this order, and ``begins`` tells where they start."""
    order = np.lexsort(hashes[::-1]) if len(hashes) > 1 else np.argsort(hashes[0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = False
    for h in hashes:
        ranked = h[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(new)


def _rows(keys: np.ndarray, firsts: np.ndarray, hashes: list[np.ndarray], where: np.ndarray, marked: np.ndarray, to: Deal, kind: type) -> pa.RecordBatch:
    """What a stretch sends: its probes by partition, its map of documents, its own repeats.

    A probe's flag tells that it is a block at one of its places.
    """
    seeds = np.arange(len(keys), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    batch = int(mix64(mix64(keys[:, 0].view(np.uint64) + seeds) ^ keys[:, 1].view(np.uint64)).sum(dtype=np.uint64).view(np.int64))
    out = [(batch % to.shares, _MAP, keys.tobytes() + firsts.astype(np.uint32).tobytes())]
    if len(where):
        order, begins = _groups(hashes)
        counts = np.diff(np.r_[begins, len(order)])
        again = np.repeat(counts > 1, counts)
        if again.any():
            out.append((batch % to.shares, _FOUND, np.sort(where[order[again]]).astype(np.uint32).tobytes()))
        first, one = where[order[begins]].astype(np.uint32), [h[order[begins]] for h in hashes]
        flags = np.logical_or.reduceat(marked[order], begins)
        ranges, part = np.divmod(one[0] >> np.uint64(33), np.uint64(to.shares))
        ranges %= np.uint64(to.ranges)
        order = np.lexsort((first, part))
        one, first, flags, ranges, part = [h[order] for h in one], first[order], flags[order], ranges[order], part[order]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            out.append((int(part[a]), _PROBES, _pack([h[a:b].astype(kind) for h in one], first[a:b], ranges[a:b], flags[a:b])))
    return _table([(part_, kind_, batch, payload) for part_, kind_, payload in out], _NAMES)


def _places(firsts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of a stretch: its place in its document, words from it to the end, words in all."""
    counts = np.diff(firsts)
    length = np.repeat(counts, counts)
    place = np.arange(total) - np.repeat(firsts[:-1], counts)
    return place, length - place, length


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)


def _probe(width: int, block_words: int, to: Deal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch)
            for block in blocks(batch.column(2), to.stretch):
                words, firsts = block.words()
                place, left, length = _places(firsts, len(words))
                where = np.flatnonzero((left >= block_words) & (length >= width))
                hashes = hash_windows(words, block_words)[where] if len(where) else np.zeros(0, np.uint64)
                yield _rows(keys[block.first : block.first + block.n], firsts[:-1], [hashes], where, place[where] % block_words == 0, to, np.uint32)

    return run


def _table(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"part": pa.int64(), "kind": pa.int32(), "batch": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[n]) for i, n in enumerate(names)], names)


def _by_range(kind: type, halves: int):
    """A partition's probes as runs of one hash range each, a bounded number of bytes at once; other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for each in batches:
            rest = []
            for _, kind_, batch, payload in zip(*(each.column(i).to_pylist() for i in range(4))):
                if kind_ != _PROBES:
                    rest.append((0, kind_, batch, payload))
                    continue
                rows.append((batch, payload))
                size += len(payload)
                if size >= DEALT_BYTES:
                    yield _table(list(_runs(rows, kind, halves)), _NAMES)
                    rows, size = [], 0
            if rest:
                yield _table(rest, _NAMES)
        if rows:
            yield _table(list(_runs(rows, kind, halves)), _NAMES)

    return run


def _answer(kind: type, halves: int, blocks_only: bool):
    """Of the probes of each hash range: those that meet a block, or a second probe, elsewhere."""

    def answers(runs: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        batch, *hashes, where, flags = (np.concatenate(x) for x in zip(*(_unpack_run(r, kind, halves) for r in runs)))
        order, begins = _groups(hashes)
        counts = np.diff(np.r_[begins, len(order)])
        met = np.add.reduceat(flags[order].astype(np.int64), begins) if blocks_only else counts
        hit = np.empty(len(order), bool)
        hit[order] = np.repeat(met, counts) > (flags[order] if blocks_only else 1)
        batch, where = batch[hit], where[hit]
        order = np.argsort(batch, kind="stable")
        batch, where = batch[order], where[order]
        cuts = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1], True]) if len(batch) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(batch[a]), _FOUND, where[a:b].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, []
        for each in batches:
            out = []
            for part, kind_, batch, payload in zip(*(each.column(i).to_pylist() for i in range(4))):
                if kind_ != _PROBES:
                    out.append((batch, kind_, payload))
                    continue
                if part != now and runs:
                    out += answers(runs)
                    runs = []
                now = part
                runs.append(payload)
            if out:
                yield _table(out, _ANSWER_NAMES)
        if runs:
            yield _table(list(answers(runs)), _ANSWER_NAMES)

    return run


def _by_document(table: pa.Table) -> pa.Table:
    """The places found in one stretch, as word numbers of each of its documents."""
    kinds, payload = table.column("kind").to_numpy(), table.column("payload").to_pylist()
    found = [np.frombuffer(payload[i], np.uint32) for i in np.flatnonzero(kinds == _FOUND)]
    keys, places = [], []
    if found:
        at = np.unique(np.concatenate(found)).astype(np.int64)
        raw = payload[int(np.flatnonzero(kinds == _MAP)[0])]
        n = len(raw) // 20
        names, firsts = np.frombuffer(raw, np.int64, 2 * n).reshape(n, 2), np.frombuffer(raw, np.uint32, n, offset=16 * n).astype(np.int64)
        owner = np.searchsorted(firsts, at, "right") - 1
        cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            keys.append(names[owner[a]].tolist())
            places.append((at[a:b] - firsts[owner[a]]).astype(np.uint32).tobytes())
    return pa.table({"key": pa.array([k[0] for k in keys], pa.int64()), "key2": pa.array([k[1] for k in keys], pa.int64()), "places": pa.array(places, pa.binary())})


def _in_turn(first, second):
    """Both steps in one Python worker; as two of Spark's steps in one task they hold a worker each."""
    return lambda batches: second(first(batches))


def _answers(sent: DataFrame, to: Deal, kind: type, halves: int, blocks_only: bool) -> DataFrame:
    """(batch, kind, payload): the answers to all probes.

    Every hash range is a group of bounded size; a partition of several sorts its runs of probes by range
    (a sort that spills) and answers one range after the other.
    """
    dealt, by_range, answer = sent.repartitionById(to.shares, F.col("part").cast("int")), _by_range(kind, halves), _answer(kind, halves, blocks_only)
    if to.ranges == 1:
        return dealt.mapInArrow(_in_turn(by_range, answer), _ANSWER)
    return dealt.mapInArrow(by_range, _ROW).sortWithinPartitions("part").mapInArrow(answer, _ANSWER)


def _found(sent: DataFrame, to: Deal, kind: type, halves: int, blocks_only: bool, what: str) -> DataFrame:
    """(key, key2, places): the answers to all probes, per document; kept as a table."""
    each = _answers(sent, to, kind, halves, blocks_only).groupBy("batch").applyInArrow(_by_document, "key long, key2 long, places binary")
    # Rows of one key have one text, hence equal places if they lie in one stretch, and else equal up to what a stretch knows of itself.
    return Kept(each.groupBy(*_KEY).agg(F.array_join(F.collect_set(F.hex("places")), "").alias("hex")).select(*_KEY, F.unhex("hex").alias("places")), what).df


def _extend(width: int, block_words: int, to: Deal):
    """The windows around each hit, sent as probes of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hits = _keys(batch), batch.column(3).to_pylist()
            for block in blocks(batch.column(2), to.stretch):
                words, firsts = block.words()
                _, left, _ = _places(firsts, len(words))
                edge = np.zeros(len(words) + 1, np.int32)
                for i in range(block.n):
                    at = np.unique(np.frombuffer(hits[block.first + i], np.uint32)).astype(np.int64)
                    np.add.at(edge, firsts[i] + np.maximum(at - (width - block_words), 0), 1)
                    np.add.at(edge, firsts[i] + at + 1, -1)
                where = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (left >= width))
                hashes = [hash_windows(w, width)[where] if len(where) else np.zeros(0, np.uint64) for w in (words, mix64(words ^ np.uint64(0x2545F4914F6CDD1D)))]
                yield _rows(keys[block.first : block.first + block.n], firsts[:-1], hashes, where, np.zeros(len(where), bool), to, np.uint64)

    return run


def _remove(width: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(text).cast(pa.binary())
            counts, removed, kept = [], [], []
            for value, places in zip(texts, batch.column(1)):
                raw = value.as_py() or b""
                words = raw.split()
                counts.append(len(words))
                if places.is_valid:
                    starts = np.unique(np.frombuffer(places.as_py(), np.uint32)).astype(np.int64)
                    edge = np.zeros(len(words) + 1, np.int32)
                    edge[starts] += 1
                    edge[starts + width] -= 1
                    left = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    removed.append(len(words) - len(left))
                    words = [words[i] for i in left]
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 35) -> DataFrame:
    """(doc, n_words, n_removed, kept_text) of every row; ``doc`` holds all columns of ``docs``.

    Words are runs of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``.  A word is removed if it is
    under a window of ``width`` words whose word sequence also starts anywhere else, in the same
    document or another one; all its copies go.  Null and empty texts have no words, and their kept text
    is empty.  Shorter texts keep all words.  Repeated rows repeat each other.  Columns of ``docs`` keep
    their names inside ``doc``, so none can clash.
    """
    block_words = (width + 1) // 2
    name = [F.xxhash64(col(id_column), col(text_column)).alias("key"), F.xxhash64(col(text_column), F.lit(1), col(id_column)).alias("key2")]
    keyed = docs.select(whole_row(docs).alias("doc"), *name)
    size = docs.agg(F.sum(F.octet_length(col(text_column)))).first()[0] or 0
    to = deal(size)
    probes = docs.select(*name, col(text_column).alias("text"))
    sent = probes.mapInArrow(sliced(_probe(width, block_words, to)), _ROW)
    hits = _found(sent, to, np.uint32, 1, True, "hits")
    keys = Kept(hits.select(*_KEY), "hit-keys").df
    around = filter_by(probes, keys, _KEY).join(hits, _KEY).mapInArrow(sliced(_extend(width, block_words, to)), _ROW)
    repeats = _found(around, to, np.uint64, 2, False, "repeats")
    keys = Kept(repeats.select(*_KEY), "repeat-keys").df
    schema = StructType([keyed.schema["doc"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    clean = filter_by(keyed, keys, _KEY, anti=True).select("doc", F.lit(None).cast("binary").alias("places"))
    dirty = filter_by(keyed, keys, _KEY).join(repeats, _KEY).select("doc", "places")
    return clean.union(dirty).mapInArrow(sliced(_remove(width, text_column)), schema)
