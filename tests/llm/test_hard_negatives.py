"""Hard negatives against all pairs in whole numbers, and the bounds that skip rows."""

import math

import numpy as np
import pytest

from lattica.llm import hard_negatives as hard


def plain(rows, every=50, positives=5, negatives=3, share=(50, 95, 100), scale=256.0):
    first = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None:
            first[i] = min(first.get(i, (label, v)), (label, v), key=lambda x: (x[0], [-math.inf if c is None else c for c in x[1]]))
    known = {i: (label, [math.floor(scale * float(c)) for c in v]) for i, (label, v) in first.items() if v and all(c is not None and math.isfinite(c) for c in v)}
    out = set()
    for a, (label, q) in known.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w)), i, l == label) for i, (l, w) in known.items() if i != a and len(w) == len(q))
        for minus, p, _ in [x for x in scored if x[2]][:positives]:
            fits = [(i, -s) for s, i, same in scored if not same and share[0] * -minus <= share[2] * -s <= share[1] * -minus]
            out |= {(a, p, k + 1, i, -minus, s) for k, (i, s) in enumerate(fits[:negatives])}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, "x") for i, l, v in rows], "vec_id long, embedding array<float>, label int, g int, kind string").repartition(4)


def rows_of(seed, n, d, labels, groups=6):
    """Clusters, copies, short and long vectors."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, d))
    x = centres[r.integers(0, groups, n)] + r.normal(size=(n, d)) * r.choice([0.02, 0.3, 1.5], (n, 1))
    x *= r.choice([0.1, 1, 1, 4], (n, 1))
    x[n // 2 : n // 2 + 20] = x[0]
    return [(int(i), int(r.integers(0, labels)), [float(np.float32(c)) for c in v]) for i, v in zip(r.permutation(n * 3)[:n], x)]


ODD = [
    (0, 1, [0.0] * 8), (50, 1, [1.0] * 8), (100, None, [1.0] * 8), (None, 1, [1.0] * 8), (150, 2, None), (200, 2, []), (250, 2, [float("nan")] * 8), (301, 2, [float("inf")] + [0.0] * 7), (350, 1, [None] + [1.0] * 7),
    (400, 1, [1.0] * 3), (401, 1, [0.9] * 3), (402, 2, [0.7] * 3), (450, 1, [-1.0] * 8), (50, 1, [1.0] * 8), (50, 3, [0.5] * 8), (501, 1, [-0.5] * 8), (502, 2, [0.4] * 8), (550, 2, [300.0, 1e5] * 4), (551, 2, [299.0, 1e5] * 4), (552, 1, [200.0, 8e4] * 4),
]


@pytest.mark.parametrize("size", [dict(), dict(BLOCK=16, GROUP=4, TASK_ROWS=64, TASK_BLOCKS=3, _AT_ONCE=64)])
def test_hard_negatives(spark, monkeypatch, size):
    for name, value in size.items():
        monkeypatch.setattr(hard, name, value)
    rows = [r for r in rows_of(1, 500, 8, 5) if r[0] > 600] + ODD
    found = hard.hard_negatives(table(spark, rows), every=10 if size else 50)
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, every=10 if size else 50)


def test_more_directions_than_rows_and_one_label(spark):
    rows = [(k, 1, [float(k), 1.0]) for k in range(0, 500, 50)]
    assert hard.hard_negatives(table(spark, rows)).count() == 0
    rows += [(7, 2, [100.0, 1.0])]
    assert {tuple(x) for x in hard.hard_negatives(table(spark, rows), positives=2).collect()} == plain(rows, positives=2)
    assert hard.hard_negatives(table(spark, rows).limit(0)).count() == 0


def test_scores_beyond_double_precision_are_whole_numbers(spark):
    r = np.random.default_rng(4)
    rows = [(k * 25, k % 2, [float(np.float32(c)) for c in r.normal(size=4) * 2e5 + 4e5]) for k in range(12)]
    assert max(x[4] for x in plain(rows)) > 2**53
    assert {tuple(x) for x in hard.hard_negatives(table(spark, rows)).collect()} == plain(rows)


def test_bounds_hold_for_every_pair():
    r = np.random.default_rng(3)
    for d in (2, 5, 40):
        x = np.floor(256 * np.concatenate([r.normal(size=(150, d)), np.zeros((1, d)), r.normal(size=(1, d)) + r.normal(size=(150, d)) * 1e-3]))
        norms = np.sqrt((x**2).sum(1))
        units = x / np.where(norms > 0, norms, 1)[:, None]
        directions = hard.spread(units[norms > 0])
        angles = np.arccos(np.clip(units @ directions.T, -1, 1)).astype(np.float32).astype(float)
        exact = x @ x.T
        for b in range(len(x)):
            low, high = hard.score_bounds((angles, angles, norms, norms), (angles[b], angles[b], norms[b], norms[b]))
            assert (low <= exact[:, b]).all() and (exact[:, b] <= high).all()
        order = np.argsort(angles[:, 0])
        for low, high in ((-np.inf, np.inf), (1.0, 5000.0), (0.0, 0.0), (20000.0, np.inf), (-5000.0, 300.0)):
            first, last = hard.window(angles[order, 0], angles[:, 0], norms, (norms.min(), norms.max()), np.full(len(x), low), np.full(len(x), high))
            for a in range(len(x)):
                inside = np.flatnonzero((exact[a, order] >= low) & (exact[a, order] <= high))
                assert not len(inside) or (first[a] <= inside[0] and inside[-1] < last[a])


def test_near_blocks_spare_most_rows():
    """Far rows aren't scored once near ones have set the least score."""
    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(size=(1, 16)) + r.normal(size=(400, 16)) * 0.05 for _ in range(5)])
    angles = np.arccos(np.clip(x @ x[0] / np.sqrt((x**2).sum(1)) / np.sqrt(x[0] @ x[0]), -1, 1))
    order = np.argsort(angles)
    norms = np.sqrt((x[order] ** 2).sum(1))
    first, last = hard.window(angles[order], np.zeros(1), norms[:1], (norms.min(), norms.max()), np.array([0.97 * norms[0] ** 2]), np.array([np.inf]))
    assert last[0] - first[0] < len(x) // 3


def test_shares_out_of_order_are_an_error(spark):
    with pytest.raises(ValueError, match="lesser"):
        hard.hard_negatives(table(spark, ODD), share=(95, 50, 100))
