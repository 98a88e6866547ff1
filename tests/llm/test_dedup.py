"""Jaccard join, substring dedup, embedding dedup and components against plain versions."""

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers

from lattica.llm import components, embedding_dedup, ngram_jaccard, substring_dedup, words


def test_word_hashes_follow_the_words():
    raw = "The  the\tTHE the\nbe à the".encode()
    data = np.frombuffer(raw, np.uint8)
    _, _, plain = words.hash_words(data)
    _, _, lower = words.hash_words(data, lower=True)
    for hashes, split in ((plain, raw.split()), (lower, raw.lower().split())):
        assert len(hashes) == len(split)
        assert [[a == b for b in hashes] for a in hashes] == [[a == b for b in split] for a in split]
    ab, ba = words.hash_windows(plain[:2], 2), words.hash_windows(plain[:2][::-1].copy(), 2)
    assert ab[0] != ba[0] and len(words.hash_windows(plain[:1], 2)) == 0


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (150, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(50)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()}
    want = helpers.components({x for e in edges for x in e}, edges)
    assert found == {k: v for k, v in want.items() if k in found} and all(want[k] == k and not any(v == k and n != k for n, v in want.items()) for k in set(want) - set(found))
    assert components.connected_components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).count() == 0


@pytest.mark.parametrize("width, num", [(3, 90), (5, 80), (1, 60)])
def test_jaccard(spark, width, num):
    rows = helpers.corpus()
    docs = spark.createDataFrame([(i, t, 7, 1) for i, t in rows], "doc_id long, text string, n int, rep int").repartition(5)
    got = ngram_jaccard.jaccard_components(docs, width=width, num=num).collect()
    want = helpers.jaccard_components(rows, width, num)
    assert len(got) == len(rows) and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_long_lists(spark, monkeypatch):
    """Lists over the limits go through tiles, of several chunks, with the same result."""
    monkeypatch.setattr(ngram_jaccard, "LONG_LIST", 4)
    monkeypatch.setattr(ngram_jaccard, "TILE_DOCS", 7)
    monkeypatch.setattr(ngram_jaccard, "HOT_LIST", 40)
    monkeypatch.setattr(ngram_jaccard, "LEADER_ROWS", 3)
    rows = helpers.corpus(3)
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == helpers.jaccard_components(rows, 3, 90)


def test_jaccard_of_two_large_groups(spark, monkeypatch):
    """Groups of near copies of texts that are alike but don't link, but for one document between them."""
    monkeypatch.setattr(ngram_jaccard, "LONG_LIST", 4)
    monkeypatch.setattr(ngram_jaccard, "TILE_DOCS", 8)
    r = random.Random(9)
    one = [f"w{k}" for k in range(150)]
    other = one[:138] + [f"v{k}" for k in range(12)]
    texts = []
    for base in (one, other):
        for _ in range(40):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(100)] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    for between in ([], [" ".join(one[:144] + other[144:])]):
        rows = list(enumerate(texts + between))
        got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == helpers.jaccard_components(rows, 3, 90)


def test_jaccard_edge_cases(spark):
    assert ngram_jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = ngram_jaccard.jaccard_components(spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (4, "A b  c d")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got if r["doc_id"]) == [(True, 1, 2, 1), (True, 2, 0, 2), (True, 3, 0, 3), (True, 4, 2, 1)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_lists_that_cross_batches():
    """A list's members may lie in several batches, whether it ends short or long."""
    import pyarrow as pa

    h = np.repeat(np.arange(6), [3, 120, 1, 2, 60, 1])
    ids = np.arange(len(h))

    def run(size):
        cuts = [pa.RecordBatch.from_arrays([pa.array(x[a : a + size]) for x in (h, ids, np.full(len(h), 50))], ["h", "id", "n"]) for a in range(0, len(h), size)]
        out = [tuple(r.values()) for b in ngram_jaccard._lists(90, 100)(iter(cuts)) for r in b.to_pylist()]
        return sorted(out)

    assert run(1000) == run(7) == run(1)
    assert sum(x[3] == -1 for x in run(7)) == 180 and sum(x[3] > 0 for x in run(7)) == 4


def test_divide_skip_links_all():
    r = np.random.default_rng(2)
    base = np.sort(r.choice(10**6, 200, replace=False).astype(np.uint64))
    sets = []
    for _ in range(80):
        keep = base[r.random(200) > r.choice([0.0, 0.03, 0.06, 0.5])]
        sets.append(np.unique(np.concatenate([keep, r.choice(10**6, r.integers(0, 12)).astype(np.uint64)])))
    links = [(x, y) for x in range(80) for y in range(x) if 190 * len(np.intersect1d(sets[x], sets[y])) >= 90 * (len(sets[x]) + len(sets[y]))]
    edges = ngram_jaccard.divide_skip(sets, None, 90, 100)
    assert helpers.components(range(80), edges) == helpers.components(range(80), links) and set(map(frozenset, edges)) <= set(map(frozenset, links))


def test_sketches_bound_the_overlap():
    r = np.random.default_rng(4)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 2**63, r.integers(1, 400)).astype(np.uint64)) for _ in range(2))
        both = np.unique(np.concatenate([a, b[: len(b) // 2]]))
        assert ngram_jaccard.most_common(ngram_jaccard.sketch(a), ngram_jaccard.sketch(both)) >= len(np.intersect1d(a, both))


@pytest.mark.parametrize("width", [35, 4])
def test_repeats(spark, width):
    rows = helpers.corpus(1)
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, n_words int, key string").repartition(3)
    got = substring_dedup.remove_repeats(docs, width=width).collect()
    want = {(i, t): x for (i, t), x in zip(rows, helpers.remove_repeats(rows, width))}
    assert len(got) == len(rows) and all((r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc"]["doc_id"], r["doc"]["text"]] for r in got)
    assert all(r["doc"]["n_words"] == 7 for r in got)


def test_repeats_in_several_ranges_of_a_partition(spark, monkeypatch):
    # Three partitions of many hash ranges each, and runs of a few probes.
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 500)
    monkeypatch.setattr(substring_dedup, "MOST_PARTITIONS", 3)
    rows = helpers.corpus(1)
    assert substring_dedup.deal(sum(len(t or "") for _, t in rows)).ranges > 5
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=4).collect()
    want = {(i, t): x for (i, t), x in zip(rows, helpers.remove_repeats(rows, 4))}
    assert len(got) == len(rows) and all((r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc"]["doc_id"], r["doc"]["text"]] for r in got)


def test_partitions_of_one_range_are_answered_by_one_worker(spark):
    """Each Python step of a task holds a worker of its own, whose memory stays with the executor."""
    r, found = np.random.default_rng(8), {}
    sides = [(r.integers(0, 300, 200).astype(np.uint64) << np.uint64(33), r.random(200) < 0.2) for _ in range(4)]
    for ranges, steps in ((1, 1), (3, 2)):
        to, rows = substring_dedup.Deal(2, ranges, 1 << 20), []
        for k, (hashes, flags) in enumerate(sides):
            sent = substring_dedup._rows(np.full((1, 2), k), np.zeros(1, np.int64), [hashes], np.arange(200), flags, to, np.uint32)
            rows += [tuple(x.values()) for x in sent.to_pylist()]
        answers = substring_dedup._answers(spark.createDataFrame(rows, substring_dedup._ROW), to, np.uint32, 1, True)
        assert answers._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == steps
        got = [(x["batch"], x["kind"], np.frombuffer(x["payload"], np.uint32).tolist() if x["kind"] == 2 else bytes(x["payload"])) for x in answers.collect()]
        maps = sorted((b, p) for b, kind, p in got if kind == 1)
        found[ranges] = maps, sorted({(b, place) for b, kind, p in got if kind == 2 for place in p})
    assert found[1] == found[3] and len(found[1][0]) == 4 and found[1][1]


def test_bytes_of_a_probe_do_not_grow_with_the_corpus():
    r, found = np.random.default_rng(5), {}
    for size in (3 * 10**10, 10**12, 10**14):
        to = substring_dedup.deal(size)
        n = to.stretch // 6
        hashes, where = r.integers(0, 2**64, n, np.uint64), np.arange(n, dtype=np.uint32)
        sent = substring_dedup._rows(np.zeros((1, 2), np.int64), np.zeros(1, np.int64), [hashes], where, where % 18 == 0, to, np.uint32)
        assert to.ranges < 2**16 and len(set(sent.column(0).to_pylist())) <= to.shares <= substring_dedup.MOST_PARTITIONS
        # An exchanged row has about 36 bytes beside its payload.
        found[size] = (len(pa.compress(b"".join(sent.column(3).to_pylist()), "lz4", asbytes=True)) + 36 * sent.num_rows) / n
        # A hash range holds the probes of about PART_BYTES of text, whatever the size.
        assert size / (to.shares * to.ranges) <= substring_dedup.PART_BYTES
    # Places take the logarithm of the partitions, and a range's number a byte.
    assert max(found.values()) < 9.5 and max(found.values()) < 1.4 * min(found.values()), found


def test_runs_keep_every_probe():
    r = np.random.default_rng(6)
    rows, sent = [], set()
    for batch in (-5, 7, 2**62):
        n = int(r.integers(1, 200))
        hashes, where = r.integers(0, 2**32, n).astype(np.uint32), np.sort(r.choice(10**6, n, replace=False)).astype(np.uint32)
        ranges, flags = r.integers(0, 5, n).astype(np.uint64), r.random(n) < 0.3
        rows.append((batch, substring_dedup._pack([hashes], where, ranges, flags)))
        sent |= set(zip([batch] * n, hashes.tolist(), where.tolist(), flags.tolist(), ranges.tolist()))
    got = [(*x, part) for part, _, _, payload in substring_dedup._runs(rows, np.uint32, 1) for x in zip(*(c.tolist() for c in substring_dedup._unpack_run(payload, np.uint32, 1)))]
    assert len(got) == len(sent) and set(got) == sent


def test_repeats_of_nothing(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = substring_dedup.remove_repeats(spark.createDataFrame([(None, "a"), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == [(0, 0, ""), (1, 0, "a")]


def brute_links(ids, vectors, cosine):
    u = np.array(vectors, float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = u @ u.T >= cosine
    np.fill_diagonal(linked, False)
    found = helpers.components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(linked))])
    return {i: (int(n), found[i]) for i, n in zip(ids, linked.sum(1))}


@pytest.mark.parametrize("d, cell_rows", [(64, 40), (64, 8192), (24, 50), (5, 30)])
def test_embeddings(spark, monkeypatch, d, cell_rows):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell_rows)
    r = np.random.default_rng(d)
    x = np.concatenate([c + r.normal(size=(r.integers(1, 30), d)) * r.choice([0.001, 0.1, 0.3, 0.4]) for c in r.normal(size=(25, d))]).astype(np.float32)
    ids = r.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, n int").repartition(4)
    got = embedding_dedup.near_duplicates(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_links(ids, x, 0.9)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("cosine, most", [(0.965, 20), (0.92, 40), (0.9, 150)])
def test_embeddings_of_a_wide_group(spark, cosine, most):
    """A group whose vectors nearly all link, at cosines that no class of mutual links holds, falls to few classes, with exact links; at 0.9, where half of the pairs link, some 6 % of the vectors stay outside."""
    r = np.random.default_rng(7)
    middle, noise = np.eye(64)[0], r.normal(size=(2000, 64)) / 8
    x = np.concatenate([np.sqrt(cosine) * middle + np.sqrt(1 - cosine) * noise, r.normal(size=(60, 64))])
    units = x / np.linalg.norm(x, axis=1)[:, None]
    names, distances, middles = embedding_dedup.group_near(units, np.sqrt(0.2))
    assert len(set(names[:2000])) <= most and set(names) == set(middles)
    assert all(abs(np.linalg.norm(units[i] - middles[names[i]]) - distances[i]) < 1e-12 for i in range(len(x)))
    ids = r.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(4)
    got = embedding_dedup.near_duplicates(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_links(ids, x, 0.9)


def test_embeddings_rows_that_share_an_id(spark):
    """Repeated rows are one vector and all returned; vectors that share an id are compared each on its own."""
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (2, [0.01, 1.0]), (3, [1.0, 0.01])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1)] * 3 + [(2, 1, 1)] * 2 + [(3, 1, 1)]


def test_embeddings_edge_cases(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [0.0, 0.0]), (4, None), (None, [1.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0, 0.0]), (7, [1.0, None]), (8, []), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), None: (0, None), **{k: (0, k) for k in (3, 4, 5, 6, 7, 8, 9)}}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_jaccard_frees_what_later_steps_do_not_read(spark, monkeypatch):
    """The leaders' sets and the lists are gone before the sets of the last search are written; all of them stayed to the end before."""
    live, beside = set(), []

    class Seen(ngram_jaccard.Kept):
        def __init__(self, df, what="kept"):
            if what == "sets":
                beside.append(sorted(w for w, _ in live))
            super().__init__(df, what)
            live.add((what, self.path))

        def drop(self):
            super().drop()
            live.discard(next(x for x in live if x[1] == self.path))

    monkeypatch.setattr(ngram_jaccard, "Kept", Seen)
    docs = spark.createDataFrame([(k, " ".join(f"w{(k % 7) * 100 + i}" for i in range(60)) + f" x{k}") for k in range(40)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(docs).collect()}
    assert found == {k: k % 7 for k in range(40)}
    assert len(beside) == 1 and not {"led-sets", "led", "lists", "met", "ends", "copies", "members"} & set(beside[0]) and {"early", "pairs", "tiles"} <= set(beside[0])
