"""Small corpora with planted cases, and plain versions of the operators to compare with."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus(seed=0, n=60):
    """(id, text): fresh texts, exact and near copies, shared passages, empty, null and tiny texts, a long one, a repeat."""
    r = random.Random(seed)
    texts = [sentence(r, r.randint(5, 300)) for _ in range(n)]
    passage = sentence(r, 60)
    for k in range(20):
        base = texts[r.randrange(n)].split()
        for _ in range(r.randint(0, 3)):
            base[r.randrange(len(base))] = "changed"
        texts.append(" ".join(base))
        if k % 3 == 0:
            texts.append(f"{sentence(r, 20)}\n{passage}\t{sentence(r, 15)}")
    hot = sentence(r, 120).split()
    for _ in range(70):
        copy = list(hot)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(len(copy))] = sentence(r, 1)
        texts.append(" ".join(copy))
    texts += [None, "", " \n\t ", "one", "one", "One two", "one  TWO", passage + " " + passage, sentence(r, 6000), "ünï   çödé", "a b c d e f " * 40]
    rows = [(k, t) for k, t in enumerate(texts)]
    r.shuffle(rows)
    return rows + rows[:3]


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def find(parents, x):
    while parents[x] != x:
        parents[x] = parents[parents[x]]
        x = parents[x]
    return x


def components(ids, links):
    parents = {i: i for i in ids}
    for a, b in links:
        a, b = find(parents, a), find(parents, b)
        parents[max(a, b)] = min(a, b)
    return {i: find(parents, i) for i in ids}


def shingles(text, width):
    w = words(text, lower=True)
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def jaccard_components(rows, width, num, den=100):
    sets = {i: shingles(t, width) for i, t in rows}
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[:x]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                links.append((a, b))
    found = components(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def remove_repeats(rows, width=35):
    """(words, removed, kept text) of each row, in order."""
    counts = {}
    split = [words(t) for _, t in rows]
    for w in split:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            counts[key] = counts.get(key, 0) + 1
    out = []
    for w in split:
        covered = [False] * len(w)
        for k in range(len(w) - width + 1):
            if counts[tuple(w[k : k + width])] > 1:
                covered[k : k + width] = [True] * width
        out.append((len(w), sum(covered), b" ".join(x for x, c in zip(w, covered) if not c).decode()))
    return out
