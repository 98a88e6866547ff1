"""Hard-negative mining by angular triangle filtering.

Every row has its angles to DIRECTIONS reference directions and its norm stored.  By the triangle inequality for angles, the angle between
an anchor and a row lies between the difference and the sum of their angles to any direction, so the cosine lies in an interval; times both norms
it bounds the score, with slack for rounding.  A row is scored, in integers, only where its bounds overlap the scores that an anchor still looks for.

* Rows are packed into blocks of at most BLOCK rows of like label and nearest direction, sorted by the angle to it; anchors into groups alike.
* A block is sent to a group only if the bounds of all its rows overlap what the group looks for; a task holds one group and streams blocks, the
  nearest first.  Inside, a block's rows that may count for an anchor are one run of its sorted angles, found by bisection.
* First each anchor's best rows of its own label are found, and what it has so far is the least score that it looks for.  Then each positive's window of scores
  is searched among the other labels, and what was found raises the window's lower end.
* Tasks send on at most the best few of each anchor or window, and a ranking that Spark limits before its shuffle joins them.

The directions are chosen from at most SAMPLE rows; they steer the work only, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import Kept, col, filter_by, sliced

DIRECTIONS, SAMPLE = 16, 1024
#: Rows of a block at most, of a group of anchors at least, groups about at most (larger tables have larger groups), and rows that a packing task takes.
BLOCK, GROUP, MOST_GROUPS, TASK_ROWS = 2048, 1024, 4096, 1 << 16
#: Blocks that one task of a group streams, about, and tasks of an exchange at most.
TASK_BLOCKS, MOST_TASKS = 64, 4000
#: Angles are single precision; the slack covers them, the arc cosine near its ends, and the products.
_ANGLE_SLACK, _SCORE_SLACK = 4e-6, 1e-9
_AT_ONCE = 1 << 21

_ROW = "id long, label long, d int, cell int, angle float, norm double, angles binary, q binary"
_PACK = "d int, n int, low_label long, high_label long, labels binary, ids binary, cells binary, norms binary, angles binary, q binary"


class Directions(dict):
    """Unit reference directions by the number of components; random ones where no sample is known."""

    def __missing__(self, d: int) -> np.ndarray:
        x = np.random.default_rng(d).normal(size=(DIRECTIONS, d))
        self[d] = x / np.sqrt((x**2).sum(1, keepdims=True))
        return self[d]


def spread(units: np.ndarray) -> np.ndarray:
    """DIRECTIONS of the rows, each the one farthest in angle from those before."""
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < min(DIRECTIONS, len(units)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def _quantised(values: list, scale: float) -> np.ndarray | None:
    x = np.array([np.nan if v is None else v for v in values], np.float64)
    return np.floor(scale * x) if len(x) and np.isfinite(x).all() else None


def _prepare(scale: float, directions: Directions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, l, q) for i, l, v in zip(*(batch.column(k).to_pylist() for k in range(3))) if (q := _quantised(v, scale)) is not None]
            for d in sorted({len(q) for _, _, q in rows}):
                some = [r for r in rows if len(r[2]) == d]
                q = np.stack([r[2] for r in some])
                top = np.abs(q).max(1)
                unit = q / np.where(top > 0, top, 1)[:, None]
                size = np.sqrt((unit**2).sum(1))
                cosines = np.clip((unit / np.where(size > 0, size, 1)[:, None]) @ directions[d].T, -1, 1)
                angles = np.arccos(cosines).astype(np.float32)
                cell = np.argmin(angles, axis=1).astype(np.int32)
                narrow = np.int16 if top.max() < 1 << 15 else np.float64
                columns = [
                    pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int64()), pa.array([d] * len(some), pa.int32()), pa.array(cell), pa.array(angles[np.arange(len(some)), cell]),
                    pa.array(size * top), pa.array([a.tobytes() for a in angles], pa.binary()), pa.array([x.tobytes() for x in q.astype(narrow)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "d", "cell", "angle", "norm", "angles", "q"])

    return run


def _pack(most: int):
    """Sorted rows to blocks: one ends at ``most`` rows, or at a new label or direction once it has a quarter of them."""

    def block(rows: list[dict]) -> pa.RecordBatch:
        d, labels = rows[0]["d"], [r["label"] for r in rows]
        wide = any(len(r["q"]) == 8 * d for r in rows)
        q = b"".join(r["q"] if not wide or len(r["q"]) == 8 * d else np.frombuffer(r["q"], np.int16).astype(np.float64).tobytes() for r in rows)
        parts = [d, len(rows), min(labels), max(labels), np.array(labels, np.int64).tobytes(), np.array([r["id"] for r in rows], np.int64).tobytes(), np.array([r["cell"] for r in rows], np.int32).tobytes()]
        parts += [np.array([r["norm"] for r in rows]).tobytes(), b"".join(r["angles"] for r in rows), q]
        return pa.RecordBatch.from_pylist([dict(zip(_NAMES, parts))], _SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                new = held and (row["label"], row["cell"]) != (held[-1]["label"], held[-1]["cell"])
                if held and (len(held) >= most or row["d"] != held[0]["d"] or new and 4 * len(held) >= most):
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    return run


_NAMES = [x.split()[0] for x in _PACK.split(", ")]
_SCHEMA = pa.schema(list(zip(_NAMES, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6])))


class Pack:
    """The rows of a block or of a group, as arrays."""

    def __init__(self, row: dict):
        self.d, n = row["d"], row["n"]
        self.low, self.high = row["low_label"], row["high_label"]
        self.labels, self.ids, self.cells = np.frombuffer(row["labels"], np.int64), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["cells"], np.int32)
        self.norms, self.angles = np.frombuffer(row["norms"], np.float64), np.frombuffer(row["angles"], np.float32).reshape(n, -1).astype(np.float64)
        self.q = np.frombuffer(row["q"], np.int16 if len(row["q"]) == 2 * n * self.d else np.float64).reshape(n, self.d).astype(np.float64)

    def around(self) -> tuple:
        """What bounds all its rows: least and largest angles to each direction, least and largest norm."""
        return self.angles.min(0), self.angles.max(0), float(self.norms.min()), float(self.norms.max())

    def runs(self) -> Iterator[tuple[int, int]]:
        """Runs of rows of one label and direction, by ascending angle to it."""
        new = (self.labels[1:] != self.labels[:-1]) | (self.cells[1:] != self.cells[:-1])
        cuts = np.flatnonzero(np.r_[True, new, True])
        return zip(cuts[:-1].tolist(), cuts[1:].tolist())


def score_bounds(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of rows with (angles from, angles to, norm from, norm to); ``a`` may hold many rows, a line each."""
    gap = np.maximum(a[0] - b[1], b[0] - a[1]).max(-1) - _ANGLE_SLACK
    total = (a[1] + b[1]).min(-1) + _ANGLE_SLACK
    top, bottom = np.cos(np.clip(gap, 0, np.pi)), np.cos(np.clip(total, 0, np.pi))
    least, most = a[2] * b[2], a[3] * b[3]
    slack = _SCORE_SLACK * most + 1e-6
    return bottom * np.where(bottom >= 0, least, most) - slack, top * np.where(top >= 0, most, least) + slack


def window(angles: np.ndarray, at: np.ndarray, norm: np.ndarray, norms: tuple[float, float], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From and to which of the rows, of these sorted angles to a direction and norms, scores with anchors at angles ``at`` may lie in low..high."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        slack = _SCORE_SLACK * norm * norms[1] + 1e-6
        lo, hi = low - slack, high + slack
        reach = lo / (norm * np.where(lo > 0, norms[1], norms[0]))
        beyond = hi / (norm * np.where(hi >= 0, norms[0], norms[1]))
    reach = np.where(np.isnan(reach), -1, reach)
    beyond = np.where(np.isnan(beyond), 1, beyond)
    wide = np.arccos(np.clip(reach, -1, 1)) + _ANGLE_SLACK
    start = np.maximum(at - wide, np.arccos(np.clip(beyond, -1, 1)) - at - _ANGLE_SLACK)
    first, last = np.searchsorted(angles, start), np.searchsorted(angles, at + wide, "right")
    return first, np.where(reach > 1, first, last)


def scored(anchors: Pack, block: Pack, some: np.ndarray, run: tuple[int, int], low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(anchor, first row, scores from there on) of the anchors ``some`` with the rows of a run that may score low..high."""
    s, e = run
    cell, norms = block.cells[s], block.norms[s:e]
    first, last = window(block.angles[s:e, cell], anchors.angles[some, cell], anchors.norms[some], (norms.min(), norms.max()), low, high)
    fits = np.flatnonzero(first < last)
    fits = fits[np.argsort(first[fits], kind="stable")]
    step = max(1, _AT_ONCE // (e - s))
    for at in range(0, len(fits), step):
        part = fits[at : at + step]
        i, j = int(first[part].min()), int(last[part].max())
        left, right = anchors.q[some[part]], block.q[s + i : s + j]
        if anchors.norms[some[part]].max() * norms.max() < 2.0**53:
            scores = (left @ right.T).astype(np.int64)  # whole numbers, exact in double precision
        else:
            scores = np.array([[int(sum(int(x) * int(y) for x, y in zip(u, v))) for v in right] for u in left], object)
        for k, p in enumerate(part):
            yield int(some[p]), s + int(first[p]), scores[k, first[p] - i : last[p] - i]


def _best(found: list[tuple[int, int]], ids: np.ndarray, scores: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The first ``most`` (score, id), by falling score, then by id."""
    if len(scores) > most:
        order = np.lexsort((ids, -scores)) if scores.dtype != object else sorted(range(len(ids)), key=lambda k: (-scores[k], ids[k]))
        ids, scores = ids[order[:most]], scores[order[:most]]
    return sorted([*found, *zip(map(int, scores), map(int, ids))], key=lambda x: (-x[0], x[1]))[:most]


class Positives:
    """Of each anchor of a group, the best rows of its own label so far."""

    def __init__(self, g: int, anchors: Pack, asked: list, most: int, share: tuple):
        self.g, self.anchors, self.most = g, anchors, most
        self.found: list[list] = [[] for _ in anchors.ids]
        self.low = np.full(len(anchors.ids), -np.inf)

    def meet(self, block: Pack) -> None:
        around = block.around()
        angles, norms = self.anchors.angles, self.anchors.norms
        reaches = score_bounds((angles, angles, norms, norms), around)[1] >= self.low
        for s, e in block.runs():
            some = np.flatnonzero(reaches & (self.anchors.labels == block.labels[s]))
            for a, at, scores in scored(self.anchors, block, some, (s, e), self.low[some], np.full(len(some), np.inf)):
                ids = block.ids[at : at + len(scores)]
                fits = np.flatnonzero((scores >= self.low[a]) & (ids != self.anchors.ids[a]))
                self.found[a] = _best(self.found[a], ids[fits], scores[fits], self.most)
                if len(self.found[a]) == self.most:
                    self.low[a] = self.found[a][-1][0]

    def results(self) -> list[tuple]:
        return [(self.g, int(a), i, score) for a, found in zip(self.anchors.ids, self.found) for score, i in found]


def window_of(score: int, share: tuple[int, int, int]) -> tuple[int, int]:
    """Scores from share[0] to share[1] parts in share[2] of ``score``, as whole numbers."""
    return -(-share[0] * score // share[2]), share[1] * score // share[2]


class Negatives:
    """Of each positive of a group's anchors, the best rows of other labels in its window so far."""

    def __init__(self, g: int, anchors: Pack, asked: list, most: int, share: tuple):
        self.g, self.anchors, self.most = g, anchors, most
        self.windows: list[list] = [[] for _ in anchors.ids]
        place = {int(i): k for k, i in enumerate(anchors.ids)}
        for anchor, positive, score in asked:
            low, high = window_of(score, share)
            if low <= high:
                self.windows[place[anchor]].append([low, high, positive, score, []])
        self.low = np.array([min((w[0] for w in x), default=np.inf) for x in self.windows], np.float64)
        self.high = np.array([max((w[1] for w in x), default=-np.inf) for x in self.windows], np.float64)

    def meet(self, block: Pack) -> None:
        angles, norms = self.anchors.angles, self.anchors.norms
        least, most = score_bounds((angles, angles, norms, norms), block.around())
        overlaps = (most >= self.low) & (least <= self.high)
        for s, e in block.runs():
            some = np.flatnonzero(overlaps & (self.anchors.labels != block.labels[s]))
            for a, at, scores in scored(self.anchors, block, some, (s, e), self.low[some], self.high[some]):
                ids = block.ids[at : at + len(scores)]
                near = np.flatnonzero((scores >= self.low[a]) & (scores <= self.high[a]))
                if not len(near):
                    continue
                ids, scores = ids[near], scores[near]
                for w in self.windows[a]:
                    fits = np.flatnonzero((scores >= w[0]) & (scores <= w[1]))
                    if len(fits):
                        w[4] = _best(w[4], ids[fits], scores[fits], self.most)
                        if len(w[4]) == self.most:
                            w[0] = w[4][-1][0]
                self.low[a] = min(w[0] for w in self.windows[a])

    def results(self) -> list[tuple]:
        return [(int(a), w[2], w[3], i, score) for a, windows in zip(self.anchors.ids, self.windows) for w in windows for score, i in w[4]]


def _deal(groups: dict[int, tuple], wanted: Callable[[tuple, Pack, tuple], float | None], shares: int):
    """A block to each group that may want it, nearest first; ``wanted`` tells its distance, None if the group doesn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Pack(row)
                around, share = block.around(), int(block.ids[0]) % shares
                for g, known in groups.items():
                    gap = wanted(known, block, around)
                    if gap is not None:
                        yield pa.RecordBatch.from_pylist([{"g": g, "share": share, "kind": 1, "gap": gap, "pack": row, "asked": None}], _TILE_SCHEMA)

    return run


_TILE = f"g long, share int, kind int, gap double, pack struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in _PACK.split(', '))}>, asked array<struct<anchor: long, positive: long, score: long>>"
_ASKED = pa.list_(pa.struct([("anchor", pa.int64()), ("positive", pa.int64()), ("score", pa.int64())]))
_TILE_SCHEMA = pa.schema([("g", pa.int64()), ("share", pa.int32()), ("kind", pa.int32()), ("gap", pa.float64()), ("pack", pa.struct(list(_SCHEMA))), ("asked", _ASKED)])


def _search(kind: type, most: int, share: tuple, names: list[str]):
    """Streams the blocks that follow each group's anchors."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, search = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(k)[at].as_py() for k, name in enumerate(batch.schema.names)}
                if row["kind"] == 0:
                    if search:
                        yield table(search.results())
                    now = (row["g"], row["share"])
                    search = kind(row["g"], Pack(row["pack"]), [(x["anchor"], x["positive"], x["score"]) for x in row["asked"] or []], most, share)
                elif now == (row["g"], row["share"]):
                    search.meet(Pack(row["pack"]))
        if search:
            yield table(search.results())

    return run


def _tiles(heads: DataFrame, blocks: DataFrame, groups: dict[int, tuple], wanted: Callable, shares: int, search: Callable, schema: str) -> DataFrame:
    """``heads`` (g, pack, asked) are sent to each share of their group, before the blocks that are dealt to it."""
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    first = heads.select("g", every.alias("share"), F.lit(0).alias("kind"), F.lit(0.0).alias("gap"), "pack", "asked")
    sent = first.union(blocks.mapInArrow(sliced(_deal(groups, wanted, shares)), _TILE))
    tasks = min(MOST_TASKS, max(1, len(groups) * shares))
    return sent.repartition(tasks, "g", "share").sortWithinPartitions("g", "share", "kind", "gap").mapInArrow(search, schema)


def _packed(rows: DataFrame, most: int, count: int, what: str) -> DataFrame:
    order = ["d", "label", "cell", "angle", "id"]
    return Kept(rows.repartitionByRange(max(1, -(-count // max(most, TASK_ROWS))), *order).sortWithinPartitions(*order).mapInArrow(_pack(most), _PACK), what).df


def _ranked(rows: DataFrame, by: list[str], score: str, name: str, most: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), name)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, share: tuple[int, int, int] = (50, 95, 100), scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x), and a score is the integer inner product; higher ones come first, then smaller ids.  Anchors are the
    rows whose id is divisible by ``every``.  An anchor's positives are its first ``positives`` other rows of its label, and of each the first ``negatives`` rows of
    another label are returned whose score s has share[0] * p <= share[2] * s <= share[1] * p for the positive's score p.

    Null ids, labels and vectors, empty vectors, and those with a null or non-finite component take no part.  Vectors of different lengths have no
    score with each other.  Of rows that repeat an id, the one of the least (label, vector) counts.  Zero vectors score 0.  A score beyond 64 bits is an error.  Other
    columns are ignored.
    """
    if not 0 <= share[0] < share[1]:
        raise ValueError("a window lies between two shares, the lesser one first")
    rows = vectors.select(col(id_column).cast("long").alias("id"), col(label_column).cast("long").alias("label"), col(vector_column).alias("v")).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    again = Kept(rows.groupBy("id").count().where("count > 1").select("id"), "again").df
    if not again.isEmpty():
        first = filter_by(rows, again, "id").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
        rows = filter_by(rows, again, "id", anti=True).unionByName(first)

    directions = Directions()
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id")).limit(SAMPLE).collect():
        q = _quantised(r["v"], scale)
        if q is not None and q.any():
            sample.setdefault(len(q), []).append(q / np.abs(q).max())
    for d, some in sample.items():
        x = np.stack(some)
        if len(x) >= DIRECTIONS:
            directions[d] = spread(x / np.sqrt((x**2).sum(1, keepdims=True)))
    known = Kept(rows.mapInArrow(sliced(_prepare(scale, directions)), _ROW), "angles").df
    asking = known.where(F.col("id") % every == 0)
    total, anchors = known.count(), asking.count()
    blocks = _packed(known, BLOCK, total, "blocks")
    groups = Kept(_packed(asking, max(GROUP, -(-anchors // MOST_GROUPS)), anchors, "groups").select(F.monotonically_increasing_id().alias("g"), F.struct(*_NAMES).alias("pack")), "numbered").df
    shares = max(1, -(-blocks.count() // TASK_BLOCKS))

    # What a group needs to be told of: labels, and the least and largest angles and norms; a group holds GROUP anchors at least, about, and their number is bounded.
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = Pack(row)
                a, b, low, high = p.around()
                yield pa.RecordBatch.from_pylist([{"g": g, "d": p.d, "low": p.low, "high": p.high, "a": a.tolist(), "b": b.tolist(), "from": low, "to": high}])

    told = {r["g"]: (r["d"], r["low"], r["high"], (np.array(r["a"]), np.array(r["b"]), r["from"], r["to"])) for r in groups.mapInArrow(summary, "g long, d long, low long, high long, a array<double>, b array<double>, from double, to double").collect()}

    def same_label(group: tuple, block: Pack, around: tuple) -> float | None:
        d, low, high, around_group = group
        meets = d == block.d and low <= block.high and block.low <= high
        return -float(score_bounds(around_group, around)[1]) if meets else None

    nothing = F.lit(None).cast(_TILE.split(", asked ")[1])
    names = ["g", "anchor", "positive", "score"]
    found = _tiles(groups.select("g", "pack", nothing.alias("asked")), blocks, told, same_label, shares, _search(Positives, positives, share, names), ", ".join(f"{c} long" for c in names))
    best = Kept(_ranked(found, ["g", "anchor"], "score", "positive", positives).drop("rank"), "positives").df

    # A group's windows, at most ``positives`` of each of its anchors, and the scores that they span.
    asked = best.groupBy("g").agg(F.collect_list(F.struct("anchor", "positive", "score")).alias("asked"), F.min("score").alias("least"), F.max("score").alias("most"))
    heads = Kept(groups.join(asked, "g"), "heads").df
    spans = {r["g"]: (r["least"], r["most"]) for r in heads.select("g", "least", "most").collect()}
    # Windows rise with the positive's score; only scores from 0 on have one.
    looking = {g: (*told[g], window_of(max(least, 0), share)[0], window_of(most, share)[1]) for g, (least, most) in spans.items() if most >= 0}

    def in_window(group: tuple, block: Pack, around: tuple) -> float | None:
        d, low_label, high_label, around_group, low, high = group
        if d != block.d or low_label == high_label == block.low == block.high:
            return None
        least, most = score_bounds(around_group, around)
        return -float(most) if most >= low and least <= high else None

    names = ["anchor", "positive", "positive_score", "negative", "score"]
    found = _tiles(heads.where(F.col("most") >= 0).select("g", "pack", "asked"), blocks, looking, in_window, shares, _search(Negatives, negatives, share, names), ", ".join(f"{c} long" for c in names))
    mined = _ranked(found, ["anchor", "positive", "positive_score"], "score", "negative", negatives)
    return mined.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
