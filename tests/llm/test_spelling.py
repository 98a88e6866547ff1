"""Spelling variants against a comparison of all pairs, and the gram index's promises."""

import random
import re
import zlib
from collections import Counter

import pytest

from lattica.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) < len(b) else (b, a)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(docs, least, count, one_in):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if one_in and h % one_in == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= least:
                n[word] += 1
    return {w: k for w, k in n.items() if k >= count}


def plain_variants(n, ratio):
    out = {}
    for w, k in n.items():
        others = [v for v in n if near(w, v)]
        best = min(((-n[v], v) for v in others if n[v] >= ratio * k), default=None)
        out[w] = (best and best[1], k, len(others), best and -best[0])
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return {(w, f, root(w), k, m, fn) for w, (f, k, m, fn) in out.items()}


def vocabulary(seed, size, letters="abcàÿ"):
    r = random.Random(seed)
    stems = ["".join(r.choice(letters) for _ in range(r.randint(6, 11))) for _ in range(size)]
    out = set(stems)
    for w in stems:
        for _ in range(3):
            i = r.randrange(len(w))
            out.add(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]]))
    return sorted(w for w in out if len(w) >= 6)


@pytest.mark.parametrize("most", [1, 20, 300])
def test_survivors_are_in_every_near_word(most):
    """Whatever the dictionary, each gram that survives an edit is one of the edited word, at the same distance, and each edit has one."""
    r = random.Random(most)
    words = vocabulary(most, 300)
    counts = Counter(x[p : p + q] for x in map(spelling._padded, words) for q in (2, 3, 4) for p in range(len(x) - q + 1))
    grams = spelling.Grams({g: n for g, n in counts.items() if n * most >= sum(v for k, v in counts.items() if len(k) == len(g)) / 8})
    for w in words:
        x = spelling._padded(w)
        asked = set(grams.asked(x))
        for i, kept in enumerate(grams.survivors(x), 1):
            assert kept
            for y in (x[:i] + x[i + 1 :], x[:i] + r.choice("abcàÿ") + x[i + 1 :]):
                there = set(grams.lists(y))
                assert {name for _, name in kept} <= there and asked & there


@pytest.mark.parametrize("most, shares", [(3, 20_000), (300, 5)])
def test_variants(spark, monkeypatch, most, shares):
    monkeypatch.setattr(spelling, "MOST_GRAMS", most)
    monkeypatch.setattr(spelling, "LIST_ROWS", shares)
    r = random.Random(5)
    n = {w: r.choice([5, 6, 30, 31, 200, 1100]) for w in vocabulary(7, 150)}
    found = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3))
    assert {tuple(x) for x in found.collect()} == plain_variants(n, 5) and found.count() == len(n)


def test_count_words(spark):
    r = random.Random(2)
    words = [*vocabulary(3, 40), "Under", "short", "ÀÉÎõü×", "KK" * 500]
    docs = [(i, " ".join(r.choice(words).title() if r.random() < 0.3 else r.choice(words) for _ in range(200)) + "9x_y") for i in range(30)]
    docs += [(30, None), (31, ""), (None, "Abcdefgh " * 9), (32, ("longer text " * 4 + "ß\n") * 30_000), docs[0], (33, "a" * 70_000)]
    table = spark.createDataFrame([(i, t, "w", 3) for i, t in docs], "doc_id long, text string, word string, n int").repartition(4)
    for one_in in (0, 7):
        found = spelling.count_words(table, one_in=one_in)
        assert {r["word"]: r["n"] for r in found.collect()} == plain_counts(docs, 6, 5, one_in)


def test_long_texts_are_split_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "_STRETCH", 7)
    text = "Some words, aLongerOneThanThat x yy\nÉtéaaaaaa " * 5
    assert sum(spelling._runs(text), Counter()) == Counter("".join(c.lower() if c < "\x80" else c for c in w) for w in re.findall("[A-Za-zÀ-ÿ]+", text))


def test_empty_table_and_words_without_a_bound(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.count_words(none)).count() == 0
    with pytest.raises(Exception, match="fewer than 6"):
        spelling.variants(spark.createDataFrame([("abc", 5)], "word string, n long")).count()
