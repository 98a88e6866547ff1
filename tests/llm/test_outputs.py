"""Packing, token files, WARC and chat: exact round trips."""

import hashlib
import random
import string
import sys
import unicodedata
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import helpers

from lattica.llm import chat, packing, token_files, tokens, warc

ODD = ["a  b   c", " x", "x ", "\n\n a \n b", "don't  stop\t\tnow \r\n x", "<|endoftext|> a<|endoftext|>b", "  ", " \n", "\n", "a\x1cb \x1c c", "日本 語", "İstanbul ΑΣ", "'s 't a's", "", "6.7 a.b .. ,.", "é ́b", "..."]


FILES = [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)]
#: Letters whose lower case or normal form isn't letters only, or has another length.
CHANGING = [c for c in map(chr, range(0x80, 0x30000)) if c.isalpha() and (not unicodedata.normalize("NFC", c).lower().isalpha() or len(unicodedata.normalize("NFC", c).lower()) > 1)]


@pytest.mark.parametrize("name, by_word", FILES)
def test_cached_encoding_is_the_tokenizers(name, by_word):
    r = random.Random(0)
    letters = [" ", "\n", "\t", "a", "B", "é", "1", "!", "'s", ".", ",", " ", "\x1f", "́", "\r", " ", "İ", "ﬁ", "ǆ", "Σ", "ß", "한", *string.punctuation, *CHANGING]
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randint(1, 30))) for _ in range(20_000)] + [t or "" for _, t in helpers.corpus()]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(1, 4))) for _ in range(80_000)]
    texts += [f"{a}{c}{m}" for a in ("", "x") for c in CHANGING for m in string.punctuation]
    mine = tokens.Encoder(public_tokenizers.path(name), by_word)
    want = mine.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert mine.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in want]


@pytest.mark.parametrize("name, by_word", FILES)
def test_strings_of_special_tokens(name, by_word):
    """Ordinary text by default; with ``special`` what a plain call of the library gives."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y.", "no such string"]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    of = lambda special: [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(public_tokenizers.path(name), by_word, special).encode(texts)]
    assert of(True) == want and max(want[0]) > 50_000 - 1_000 * by_word
    last = max(want[1])
    assert all(last not in ids for ids in of(False)) and of(False)[3] == want[3]


def test_limits_are_at_least_one():
    for name in ("tokens", "segments", "loss", "waiting"):
        with pytest.raises(ValueError):
            packing.Limits(**{name: 0})


def ids_of(name, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(spark):
    rows = [(i, t) for i, t in dict(helpers.corpus()).items()]
    limits = packing.Limits(tokens=256, segments=5, loss=200, waiting=16)
    docs = spark.createDataFrame([(i, t, 30 if i % 2 else None, 1) for i, t in rows], "doc_id long, text string, silent int, offset int").repartition(3)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), limits=limits, silent_column="silent").toPandas()
    for i, t in rows:
        ids, at = ids_of("word_bpe_49k.json", t, 1), 0
        for p in got[got.doc_id == i].sort_values("start").itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    got["loss"] = [max(0, p.start + p.length - max(p.start, 30 if p.doc_id % 2 else 0)) for p in got.itertuples()]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 256 and len(s) <= 5 and s.loss.sum() <= 200
        assert (s.offset == s.length.cumsum() - s.length).all()


def test_packing_fills(spark):
    docs = spark.createDataFrame(helpers.corpus(2), "doc_id long, text string").coalesce(1)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).toPandas()
    filled = got.groupby("sequence_id").length.sum()
    assert (filled < 2048).sum() <= 1 and filled.max() == 2048
    assert packing.pack(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert packing.pack(spark.createDataFrame([(None, None)], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).first()["length"] == 1


REPEATED = [(3, "one two"), (3, "one two"), (3, "another text"), (1, None), (1, ""), (None, "x y"), (None, "x y"), (2, "long " * 3000)]


def test_packing_of_repeated_rows(spark):
    """Rows that repeat an id or a text are each packed, as many times as they come."""
    docs = spark.createDataFrame(REPEATED, "doc_id long, text string").repartition(2)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).toPandas()
    want = [(i if i is not None else -1, len(ids_of("word_bpe_49k.json", t, 1))) for i, t in REPEATED]
    first = got[got.start == 0]
    assert sorted(zip(first.doc_id.fillna(-1).astype(int), first.doc_tokens)) == sorted(want)
    assert got.length.sum() == sum(n for _, n in want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 2048 and (s.offset == s.length.cumsum() - s.length).all()


def test_token_files_of_repeated_rows(spark, monkeypatch):
    """Null ids come first, and rows that share an id follow each other, none lost."""
    monkeypatch.setattr(token_files, "FILE_IDS", 500)
    docs = spark.createDataFrame(REPEATED, "doc_id long, text string").repartition(3)
    found = token_files.read_tokens(token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))).orderBy("start").collect()
    key = lambda i: -1 if i is None else i
    assert [key(r["id"]) for r in found] == sorted(key(i) for i, _ in REPEATED)
    assert sorted((key(r["id"]), bytes(r["ids"])) for r in found) == sorted((key(i), ids_of("byte_bpe_50k.json", t, 2).tobytes()) for i, t in REPEATED)
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1].tolist()]


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 3000)
    rows = dict(helpers.corpus())
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows.items()], "doc_id long, text string, ids int").repartition(3)
    manifest = token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    for r in token_files.read_tokens(manifest).orderBy("id").collect():
        ids = ids_of("byte_bpe_50k.json", rows[r["id"]], 2)
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(ids), ids.tobytes())
        start += len(ids)
    assert token_files.read_tokens(token_files.write_tokens(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("unit", [1, 8])
def test_direct_access(unit):
    r = np.random.default_rng(0)
    for ids in (np.zeros(5, np.uint32), np.array([], np.uint32), r.integers(0, 50_000, 5000).astype(np.uint32), (r.pareto(0.5, 20_000) * 9).clip(0, 2**24).astype(np.uint32)):
        raw = b"".join(token_files.encode(ids, np.array([0]), [1], unit))
        reads = []
        file = token_files.TokenFile(lambda a, n: (reads.append(n), raw[a : a + n])[1])
        assert (file.get(0, len(ids)) == ids).all()
        reads.clear()
        for i in r.integers(0, max(1, len(ids)), 50 if len(ids) else 0):
            assert file.get(int(i), 1)[0] == ids[i]
        assert not reads or max(reads) <= token_files.RANK_EVERY // 8 + 1  # no block is decoded
        with pytest.raises(IndexError):
            file.get(len(ids), 1)
    with pytest.raises(ValueError):
        token_files.TokenFile(lambda a, n: b"x" * n)


PAGES = [(3, "http://www.b.com/x?q=1", "same"), (1, "https://b.com:8080/", "same"), (2, None, None), (5, "not a url\r\n", ""), (None, "http://[bad", "same"), (9, "http://www.b.com/x?q=1#f", "a\r\n\r\nb é"), (4, "http://a.org/", "same")]


def test_archives(spark):
    pages = spark.createDataFrame([(i, u, h, "k") for i, u, h in PAGES], "page_id long, url string, html string, sha1 string").repartition(2)
    manifest = warc.write_archives(pages)
    rows = warc.read_records(warc.lookup(manifest, pages.union(pages))).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(got) == len(rows) == len(PAGES)
    for i, url, html in PAGES:
        raw = (html or "").encode()
        assert got[i]["payload_digest"] == warc.digest(raw) and got[i]["payload_bytes"] == len(raw) and (got[i]["url"] is None) == (url is None)
        first = {3: 1, 4: 1, 5: 2}.get(i)
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", first) if first else ("response", None))
        assert first or bytes(got[i]["payload"]) == raw
    index = warc.Index([tuple(r) for r in manifest.collect()])
    assert sorted(c[1] for c in index.captures("https://www.b.com/x?q=1")) == [3, 9] and index.captures("http://nobody.org/") == []
    assert sorted(r["page_id"] for r in warc.lookup(manifest, spark.createDataFrame([("https://www.b.com/x?q=1",), ("http://nobody.org/",), (None,)], "url string")).collect()) == [2, 3, 9]
    short = warc.write_archives(pages, min_bytes=100)
    assert {r["record_type"] for r in warc.read_records(warc.lookup(short, pages)).collect()} == {"response"}
    none = pages.limit(0)
    assert warc.read_records(warc.lookup(warc.write_archives(none), pages)).count() == 0 == warc.lookup(manifest, none).count()


def test_record_ids_are_unique(spark):
    """Repeated rows, ids with two payloads and null ids; a revisit names its response."""
    rows = [(1, "http://a.org/", "x"), (1, "http://a.org/", "x"), (1, "http://a.org/", "y"), (2, "http://a.org/", "x"), (None, "http://a.org/", "x"), (None, "http://a.org/", "x")]
    index = warc.Index([tuple(r) for r in warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()])
    heads = [index.read(c)[0] for c in index.captures("http://a.org/")]
    ids = [h["warc-record-id"] for h in heads]
    assert len(ids) == len(set(ids)) == len(rows) and [h["warc-type"] for h in heads].count("revisit") == 1
    refers = next(h["warc-refers-to"] for h in heads if h["warc-type"] == "revisit")
    assert any(i.startswith(refers[:-1]) for i in ids)


def test_index_over_many_blocks_and_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "INDEX_LINES", 8)
    pages = spark.createDataFrame([(k, f"http://h{k % 4}.org/p", f"{k}") for k in range(40)], "page_id long, url string, html string")
    manifest = warc.write_archives(pages)
    assert manifest.count() > 2
    index = warc.Index([tuple(r) for r in manifest.collect()])
    for k in range(4):
        found = index.captures(f"http://h{k}.org/p")
        assert sorted(c[1] for c in found) == list(range(k, 40, 4)) and all(index.read(c)[1] == str(c[1]).encode() for c in found)
    assert sorted(r["page_id"] for r in warc.lookup(manifest, pages).collect()) == list(range(40))


def test_url_keys():
    assert warc.url_key("http://www.A.com:80/X?y#z") == "com,a,www)/x?y" and warc.url_key(None) == ")/"
    assert warc.url_key("https://a.com:8443") == "com,a:8443)/"


def test_escapes():
    t, r = chat.Template(), random.Random(1)
    parts = ["\\", "|", "<", "[", "/", "s>", "</s>", "[INST]", "<s>", "[/INST]", "[NAME]", "<</SYS>>", "a", "<s>[ANS]"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 8)))
        assert t.plain(t.escaped(text)) == text and not any(c in t.escaped(text) for c in t.controls())


TURNS = [(1, 0, "system", "be </s> good"), (1, 1, "user", "hi\n"), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "early"), (2, 0, "tool[NAME]", None), (None, 0, None, "x"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 1, "assistant", ""), (4, 0, "user", "")]


def test_chat(spark):
    turns = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, part int").repartition(3)
    segments = chat.format_conversations(turns)
    got = {r["conv_id"]: r for r in chat.digests(segments).collect()}
    for conv in {t[0] for t in TURNS}:
        mine = sorted(((t[1], t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: False, None: False, 3: False, 4: True}
    assert chat.digests(chat.format_conversations(turns.limit(0))).count() == 0
    with pytest.raises(ValueError):
        list(chat.Parser(chat.Template()).feed("nonsense"))
