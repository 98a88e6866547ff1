"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine ``>= c`` lie within ``R``, ``R**2 = 2 - 2 c``, of each other.  Rotated and
split into blocks, their squared distances add up over the blocks, so in at least one block they
are within the block's share of ``R**2``.  Each block is range-joined under its share, and the union
of the candidates is verified exactly, in double precision.

* Vectors met in the same batch within ``NEAR * R`` of a first one are one class before anything is shuffled; its members all link, as 2 NEAR < 1.
  Where many more are within ``R`` of it, those around their mean are a class instead, whose middle is the mean: a class of near vectors (``loose``, if
  wider than ``R / 2``) doesn't fall to one class a vector, however its links lie.
* Two classes link entirely or not at all unless the middles' distance is within the radii of ``R``; only then, and inside a loose class,
  are members compared, in a task that holds two classes, each of a batch at most.  It gives each member's count of links, and an edge to the least member it
  is linked to by links that the task sees; so pairs of members are counted, never written.
* The range join deals each block's vectors to cells around pivots.  A vector goes to the tile
  of its cell and another one if it lies near enough to the plane between them; tiles are bounded,
  as large cells are split.  A block has LEAST_CELLS cells until they hold CELL_ROWS centres each, so
  a vector is sent a bounded number of times up to half a million centres; beyond, the number grows with theirs
  divided by CELL_ROWS, as far as the planes don't prune.  The pivots (a sample of at most MOST_CELLS
  centres) steer the work only, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Kept, col, sliced
from lattica.llm.components import connected_components
from lattica.llm.words import mix64

#: Radii of classes, as parts of R, and vectors that are worth a loose one.
NEAR, LOOSE, LEAST_LOOSE = 0.44, 0.8, 16
BLOCK_DIMENSIONS = 16
#: Centres a cell holds at most, about, which bounds a tile's memory; cells a block has, and centres that don't need several.
CELL_ROWS, LEAST_CELLS, MOST_CELLS, ONE_CELL = 65_536, 8, 4096, 1024
#: Numbers of a table of distances, and rows of a batch, that a task holds at once.
_AT_ONCE = 1 << 21
_SLACK = 1e-5


def rotation(d: int) -> np.ndarray:
    """The same random rotation on every executor."""
    q, r = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def block_bounds(d: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, d, max(1, d // BLOCK_DIMENSIONS) + 1).astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def _unit(values) -> np.ndarray | None:
    """The vector at length one; None if it is null, empty, zero or not finite."""
    if values is None or not len(values):
        return None
    x = np.array([np.nan if v is None else v for v in values], np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def _distances(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - middle) ** 2).sum(1))


def group_near(units: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(naming row of each row's class, distance to the class's middle, the middles by naming row); the first of the rows not yet taken names a class."""
    n = len(units)
    name, distance, middles = np.arange(n), np.zeros(n), {}
    turned = units @ rotation(units.shape[1])[:, :4]
    cell = np.unique(np.floor(turned / 0.25).astype(np.int64), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(cell, kind="stable")
    cuts = np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1], True])
    free = np.ones(n, bool)
    for c in np.argsort(cuts[:-1] - cuts[1:], kind="stable"):  # large cells first: they hold the middles of what lies around them
        rest = order[cuts[c] : cuts[c + 1]]
        while len(rest := rest[free[rest]]):
            first = int(rest[0])
            middle, rows, gap = units[first], rest, _distances(units[rest], units[first])
            gap[0] = 0.0
            radius, near, linked = NEAR * reach, (gap <= NEAR * reach).sum(), gap <= reach
            if linked.sum() >= max(LEAST_LOOSE, 2 * near):
                mean, every = units[rest[linked]].mean(0), np.flatnonzero(free)
                around = _distances(units[every], mean)
                if around[np.searchsorted(every, first)] <= LOOSE * reach and (around <= LOOSE * reach).sum() > near:
                    middle, rows, gap, radius = mean, every, around, LOOSE * reach
            taken = rows[gap <= radius]
            name[taken], distance[taken], middles[first], free[taken] = first, gap[gap <= radius], middle, False
    return name, distance, middles


#: A vector with its class; the one that names a class carries its middle.
_VECTOR = "key long, id long, d int, centre long, distance double, unit binary, middle binary"


def _classes(reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            units = [_unit(v) for v in batch.column(2).to_pylist()]
            for d in sorted({len(u) for u in units if u is not None}):
                rows = np.array([i for i, u in enumerate(units) if u is not None and len(u) == d])
                stacked = np.stack([units[i] for i in rows])
                centre, distance, middles = group_near(stacked, reach)
                middle = [middles[i].tobytes() if i in middles else None for i in range(len(rows))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[rows]), pa.array(ids[rows]), pa.array([d] * len(rows), pa.int32()), pa.array(keys[rows[centre]]), pa.array(distance),
                        pa.array([u.tobytes() for u in stacked], pa.binary()), pa.array(middle, pa.binary()),
                    ],
                    ["key", "id", "d", "centre", "distance", "unit", "middle"],
                )

    return run


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimensions, keys, radii, rotated units) of a batch of (key, d, unit, radius)."""
    keys, ds, raw, radii = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3).to_numpy()
    for d in np.unique(ds):
        rows = np.flatnonzero(ds == d)
        yield int(d), keys[rows], radii[rows], np.frombuffer(b"".join(raw[i] for i in rows), np.float64).reshape(-1, d) @ rotation(int(d))


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0)


def _slices(rows: int, width: int) -> Iterator[slice]:
    """Runs of rows whose table of ``width`` columns is bounded."""
    step = max(1, _AT_ONCE // max(1, width))
    return (slice(at, at + step) for at in range(0, rows, step))


def cells_of(n: int) -> int:
    """Cells of a block of ``n`` centres."""
    return min(MOST_CELLS, max(min(LEAST_CELLS, -(-n // ONE_CELL)), -(-n // CELL_ROWS)))


class Pivots(dict):
    """Rotated pivots by length; a length without any has one cell, around the origin."""

    def __missing__(self, d: int) -> np.ndarray:
        return np.zeros((1, d))


def _homes(pivots: Pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, _, _, turned in _by_dimension(batch):
                for b, (lo, hi) in enumerate(block_bounds(d)):
                    own = pivots[d][:, lo:hi]
                    home = np.concatenate([np.argmin(_to_pivots(turned[some, lo:hi], own), axis=1) for some in _slices(len(turned), len(own))])
                    cells, counts = np.unique(home, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(cells), pa.int32()), pa.array([b] * len(cells), pa.int32()), pa.array(cells, pa.int64()), pa.array(counts, pa.int64())], ["d", "block", "cell", "n"])

    return run


_TILE = "d int, block int, low long, high long, side int, key long, radius double, x binary"


def _deal(pivots: Pivots, parts: dict[tuple[int, int, int], int], reach: float, widest: float):
    """Each block of each centre to the tiles in which it may meet a partner of a radius up to ``widest``.

    A tile is a pair of units, a unit a cell's share: cell * 2**20 + share.
    """

    def deal(d: int, b: int, x: np.ndarray, own: np.ndarray, apart: np.ndarray, split: np.ndarray, keys: np.ndarray, radii: np.ndarray, part: float) -> pa.RecordBatch:
        share = (reach + radii + widest) * part + _SLACK
        squares = _to_pivots(x, own)
        home = np.argmin(squares, axis=1)
        # The distance to the plane between the home's pivot and another one.
        beyond = squares - squares[np.arange(len(x)), home][:, None] > 2 * apart[home] * share[:, None] + _SLACK
        unit = home * (1 << 20) + (mix64(keys.view(np.uint64)) % split[home].astype(np.uint64)).astype(np.int64)
        rows, cells = np.nonzero(~beyond)
        times = split[cells]
        rows, cells = np.repeat(rows, times), np.repeat(cells, times)
        other = cells * (1 << 20) + (np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times))
        mine = unit[rows]
        side = np.where(mine == other, 2, (mine > other).astype(int))
        raw = [v.tobytes() for v in x.astype(np.float32)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d] * len(rows), pa.int32()), pa.array([b] * len(rows), pa.int32()), pa.array(np.minimum(mine, other)), pa.array(np.maximum(mine, other)),
                pa.array(side, pa.int32()), pa.array(keys[rows]), pa.array(radii[rows]), pa.array([raw[i] for i in rows], pa.binary()),
            ],
            ["d", "block", "low", "high", "side", "key", "radius", "x"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, keys, radii, turned in _by_dimension(batch):
                for b, (lo, hi) in enumerate(block_bounds(d)):
                    own = pivots[d][:, lo:hi]
                    apart = np.sqrt(_to_pivots(own, own))
                    split = np.array([parts.get((d, b, c), 1) for c in range(len(own))])
                    # A row may go to every unit, and an output row takes about 16 numbers.
                    for some in _slices(len(turned), 16 * int(split.sum())):
                        yield deal(d, b, turned[some, lo:hi], own, apart, split, keys[some], radii[some], np.sqrt((hi - lo) / d))

    return run


def _range_join(reach: float):
    """Pairs of a tile within the block's share of the squared distance."""

    def run(table: pa.Table) -> pa.Table:
        keys, side = table.column("key").to_numpy(), table.column("side").to_numpy()
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(len(keys), -1)
        share = x.shape[1] / table.column("d")[0].as_py()
        radius = table.column("radius").to_numpy()
        half = (x**2).sum(1, keepdims=True) / 2
        one = np.ones_like(half)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        left = left[np.argsort(radius[left], kind="stable")]
        a, b = np.hstack([x, -half, one])[left], np.hstack([x, one, -half])[right].T.copy()
        found = []
        for some in _slices(len(a), b.shape[1]):  # |x - y|**2 / 2 is half + half - x y
            mine = radius[left[some]]
            most = reach + radius[right] + (mine[:, None] if mine.any() else 0)
            i, j = np.nonzero(a[some] @ b >= (-(most**2) * share / 2 - _SLACK).astype(np.float32))
            i, j = left[some][i], right[j]
            fits = (i < j) | (side[i] != side[j])
            found.append((keys[i[fits]], keys[j[fits]]))
        p, q = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": np.minimum(p, q), "b": np.maximum(p, q)})

    return run


def _judge(cosine: float):
    """Pairs of classes with their centres and radii: 1 if all members link, 2 if members have to be compared."""
    radius = np.sqrt(2 - 2 * cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = []
            for u, v, r in zip(batch.column(2), batch.column(3), batch.column(4).to_numpy()):
                u, v = np.frombuffer(u.as_buffer(), np.float64), np.frombuffer(v.as_buffer(), np.float64)
                if r == 0:
                    kinds.append(int(u @ v >= cosine))
                else:
                    gap = np.sqrt(((u - v) ** 2).sum())
                    kinds.append(1 if gap + r <= radius - 1e-9 else 0 if gap - r > radius + 1e-9 else 2)
            kinds = pa.array(kinds, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kinds], ["a", "b", "kind"])

    return run


def _roots(parent: np.ndarray, of: np.ndarray) -> np.ndarray:
    while True:
        up = parent[of]
        if (up == of).all():
            return of
        of = up


def _compare(cosine: float):
    """Members of two classes, or (side 0 only) of one: each one's links, its node, and the least node that it is linked to by these links."""

    def run(table: pa.Table) -> pa.Table:
        side, keys, nodes = (table.column(c).to_numpy() for c in ("side", "key", "node"))
        units = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(keys), -1)
        alone = not side.any()
        left = np.flatnonzero(side == 0)
        right = left if alone else np.flatnonzero(side == 1)
        counts, parent = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for some in _slices(len(left), len(right)):
            linked = units[left[some]] @ units[right].T >= cosine
            if alone:
                linked[np.arange(len(linked)), np.arange(some.start, some.start + len(linked))] = False
            else:
                counts[right] += linked.sum(0)
            counts[left[some]] += linked.sum(1)
            for row, i in zip(linked, left[some]):
                if row.any():
                    roots = _roots(parent, np.r_[i, right[row]])
                    parent[roots] = parent[i] = roots.min()
        least = nodes.copy()
        roots = _roots(parent, parent)
        np.minimum.at(least, roots, nodes)
        has = counts > 0
        return pa.table({"key": keys[has], "n": counts[has], "node": nodes[has], "least": least[roots][has]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, and
    vectors of different lengths don't link.  Rows that repeat id and vector count as one vector, and
    each is returned; a null id links with nothing and has a null component.  Ids are whole numbers (others have to be cast before).  Other columns are ignored.
    """
    reach = float(np.sqrt(2 - 2 * cosine))
    named = vectors.select(col(id_column).cast("long").alias("id"), col(vector_column).alias("v")).withColumn("row", F.monotonically_increasing_id())
    kept = Kept(named.withColumn("hash", F.when(F.col("id").isNotNull() & F.col("v").isNotNull(), F.xxhash64("v"))), "rows").df
    # A vector is named by its first row: names can't collide, and the hash tells vectors of one id apart only.
    again = Kept(kept.where("hash IS NOT NULL").groupBy("id", "hash").agg(F.min("row").alias("key"), F.count("*").alias("times")).where("times > 1").drop("times"), "again").df
    rows = kept.join(again, ["id", "hash"], "left").withColumn("key", F.coalesce("key", "row"))
    known = Kept(rows.where("hash IS NOT NULL AND key = row").select("key", "id", "v").mapInArrow(_classes(reach), _VECTOR), "vectors").df
    sizes = known.groupBy("centre").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.min("id").alias("least"))
    middles = known.where("middle IS NOT NULL").select(F.col("key").alias("centre"), "d", F.col("middle").alias("unit"))
    classes = Kept(sizes.join(middles, "centre").withColumn("loose", 2 * F.col("radius") > F.lit(reach - 1e-9)), "centres").df
    # What a member is in the graph of components: its class, if all of it links, else itself.
    node = F.when(F.col("loose"), F.col("id")).otherwise(F.col("least")).alias("node")
    of = classes.select("centre", "least", "loose")
    members = Kept(known.select("key", "id", "centre").join(of, "centre").select("key", "centre", "loose", node), "members").df

    widest = float(classes.agg(F.max("radius")).first()[0] or 0.0)
    pivots = Pivots()  # lengths of few vectors need none
    for d, n in classes.groupBy("d").count().where(F.col("count") > min(ONE_CELL, CELL_ROWS)).orderBy(F.desc("count")).limit(100).collect():
        some = classes.where(F.col("d") == d).orderBy(F.xxhash64("centre")).limit(cells_of(n)).select("unit").collect()
        pivots[d] = np.stack([np.frombuffer(r["unit"], np.float64) for r in some]) @ rotation(d)
    usual = classes.select("centre", "d", "unit", "radius")
    counted = usual.mapInArrow(sliced(_homes(pivots)), "d int, block int, cell long, n long").groupBy("d", "block", "cell").agg(F.sum("n").alias("n"))
    parts = {(r["d"], r["block"], r["cell"]): -(-r["n"] // (2 * CELL_ROWS)) for r in counted.where(F.col("n") > 2 * CELL_ROWS).collect()}
    tiles = usual.mapInArrow(sliced(_deal(pivots, parts, reach, widest)), _TILE)
    pairs = Kept(tiles.groupBy("d", "block", "low", "high").applyInArrow(_range_join(reach), "a long, b long").distinct(), "pairs").df

    left, right = (classes.select(F.col("centre").alias(k), F.col("unit").alias(f"unit_{k}"), F.col("radius").alias(f"radius_{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "unit_a", "unit_b", (F.col("radius_a") + F.col("radius_b")).alias("r"))
    judged = Kept(both.mapInArrow(sliced(_judge(cosine)), "a long, b long, kind int").where("kind > 0"), "judged").df
    loose = classes.where("loose").select(F.col("centre").alias("a"), F.col("centre").alias("b"))
    doubtful = judged.where("kind = 2").select("a", "b")
    full = known.select("key", "id", "centre", "unit").join(of, "centre").select("centre", "key", "unit", node)
    sides = [links.join(full.withColumnRenamed("centre", k), k).select("a", "b", F.lit(side).alias("side"), "key", "unit", "node") for side, k, links in ((0, "a", doubtful.union(loose)), (1, "b", doubtful))]
    some = Kept(sides[0].union(sides[1]).groupBy("a", "b").applyInArrow(_compare(cosine), "key long, n long, node long, least long"), "some").df

    whole = judged.where("kind = 1").select("a", "b")
    ends = whole.union(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
    between = ends.join(classes.select(F.col("centre").alias("b"), "n", F.col("least").alias("other")), "b")
    between = Kept(between.groupBy(F.col("a").alias("centre")).agg(F.sum("n").alias("beyond"), F.min("other").alias("other")), "between").df
    extra = some.groupBy("key").agg(F.sum("n").alias("extra"))
    least = [classes.select(F.col("centre").alias(k), F.col("least").alias(f"least_{k}")) for k in "ab"]
    edges = whole.join(least[0], "a").join(least[1], "b").select(F.col("least_a").alias("node"), F.col("least_b").alias("least"))
    # All members of a loose class that links entirely with another are linked through it.
    edges = edges.union(members.where("loose").join(between, "centre").select("node", "other")).union(some.select("node", "least").distinct())
    found = connected_components(edges, "node", "least")
    of_class = classes.select("centre", F.when(F.col("loose"), 0).otherwise(F.col("n") - 1).alias("inside")).join(between.drop("other"), "centre", "left")
    of_vector = members.select("key", "centre", "node").join(of_class, "centre").join(extra, "key", "left").join(found, "node", "left")
    links = F.col("inside") + F.coalesce("beyond", F.lit(0)) + F.coalesce("extra", F.lit(0))
    of_vector = of_vector.select("key", links.alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.select("key", "id").join(of_vector, "key", "left")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
