"""Phrase collocations against a plain version: counters over Python words."""
import re
from collections import Counter

import numpy as np
import pytest

from pliego.llm import collocations as C
from pliego.llm import common


def plain(rows, top=2000, threshold=10, percent=50, longest=3):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    out = []
    cand = {(g, p): a for (g, p), a in f.items() if len(p) > 1 and a >= threshold}
    longer = Counter()
    for (g, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[g, p[i:i + k]] = max(longer[g, p[i:i + k]], a)
    for lang in n:
        rows = []
        for (g, p), a in cand.items():
            if g != lang or 100 * longer[g, p] >= percent * a and longer[g, p]:
                continue
            score, _, l, r = min((10 ** 6 * a * a // (f[g, p[:k]] * f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def docs(spark, rows, schema="lang string, text string"):
    return spark.createDataFrame(rows, schema)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("capacity", [2, 5, 40, 1000])
def test_summary_keeps_what_is_frequent(capacity):
    """Any stream in any order; where the mass is over capacity times threshold too."""
    rng = np.random.default_rng(capacity)
    for _ in range(30):
        s = C.MisraGries(capacity, 10)
        true = Counter()
        for _ in range(20):
            keys = np.unique(rng.zipf(1.3, 60).astype(np.uint64) % np.uint64(300))
            counts = rng.integers(1, 4, len(keys))
            true.update(dict(zip(keys.tolist(), counts.tolist())))
            s.add(keys, counts)
        kept = set(s.survivors().tolist())
        assert {k for k, c in true.items() if c >= 10} <= kept
        assert s.lost < 10
        at = dict(zip(s.keys.tolist(), s.counts.tolist()))
        assert all(c - s.lost <= at.get(k, 0) <= c for k, c in true.items())
        if sum(true.values()) < 10 * capacity:
            assert s.lost == 0 or len(s.keys) <= 2 * capacity


def test_summary_stays_small():
    """Ten times more distinct keys than counters; the mass allows the capacity."""
    rng = np.random.default_rng(3)
    s = C.MisraGries(1000, 10)
    for _ in range(90):
        s.add(np.unique(rng.integers(0, 1 << 60, 100, np.uint64)), np.ones(100, np.int64)[:100])
        s.add(np.array([7], np.uint64), np.array([1]))
    s.merge()
    assert len(s.keys) <= 2000 and 7 in s.survivors()


def test_words_equal_the_rule():
    texts = ["Ab c", "", "x.y", " a\tb ", "é ü Ö", "a\x0bb\x0cc\rd\ne", "!?", "one", "two three", "A" * 5000 + " b", "a\x1cb c"]
    data = [t.encode() for t in texts]
    w = C.Words(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))))
    want = [(k, word) for k, t in enumerate(texts) for p in re.split(r"[.,;:!?\x0A-\x0D]", t) for word in re.findall(r"[^\x20\x09]+", p)]
    assert [(int(k), w.buf[s:e].tobytes().decode()) for k, s, e in zip(w.text, w.start, w.end)] == want
    pairs = sum(max(0, len(re.findall(r"[^\x20\x09]+", p)) - 1) for t in texts for p in re.split(r"[.,;:!?\x0A-\x0D]", t))
    assert w.whole(2).sum() == pairs
    h = w.hashes(0, np.zeros(len(texts), np.uint64))[0]
    low = [(t.lower() if t.isascii() else t) for _, t in want]
    assert len(set(h.tolist())) == len(set(low))


def test_whole_table_equals_plain_version(spark, sf_dir):
    from pliego.llm.queries import QUERIES
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()]
    want = plain(rows)
    assert got(QUERIES["op13_collocations"](spark, sf_dir)) == want and len(want) > 100


@pytest.mark.parametrize("small", [False, True])
def test_small_parts_summaries_and_bitmaps(spark, monkeypatch, small):
    """Tiny parts, held counts, bitmaps, summaries, phrase stores and ranking groups change nothing."""
    if small:
        for name, value in dict(PART=64, HELD=50, CAPACITY=16, PHRASES=20).items():
            monkeypatch.setattr(C, name, value)
        for name, value in dict(BITS_LEAST=7, BITS_MOST=7, RANKED=6).items():
            monkeypatch.setattr(common, name, value)
    rng = np.random.default_rng(8)
    words = ["The", "of", "new", "york", "city", "a", "und", "Straße", "x-y", "zz"]
    rows = [(["de", None, "en", "und"][rng.integers(0, 4)],
             " ".join(words[i] + [" ", "", ".", ",", "\t", "\n"][rng.integers(0, 6)] for i in rng.zipf(1.4, rng.integers(0, 60)) % 10))
            for _ in range(150)]
    df = docs(spark, rows).repartition(5)
    assert got(C.collocations(df, top=7)) == plain(rows, top=7)
    assert got(C.collocations(df, max_words=2, threshold=3)) == plain(rows, threshold=3, longest=2)


def test_equal_hashes_stay_apart(spark, monkeypatch):
    """With a first hash of 4 bits all phrases collide; the second tells them apart."""
    monkeypatch.setattr(C.Words, "hashes", lambda self, which, salt, f=C.Words.hashes: [
        x & np.uint64(15) if which == 0 else x for x in f(self, which, salt)])
    rows = [("en", "alpha beta gamma delta. alpha beta, gamma delta beta gamma")] * 12 + [("fr", "alpha beta gamma")] * 11
    assert got(C.collocations(docs(spark, rows))) == plain(rows)


def test_products_past_64_bits(spark):
    big = 3 * 10 ** 12
    rows = [("en", "a", 1, big + 7), ("en", "b", 1, big + 10), ("en", "a b", 2, big - 1)]
    r = C.cut_scores(spark.createDataFrame(rows, "lang string, phrase string, words int, f long"), 2).first()
    assert r.score == 10 ** 6 * (big - 1) ** 2 // ((big + 7) * (big + 10)) and (r.l, r.r) == (big + 7, big + 10)


def test_ties_and_cuts(spark):
    rows = [("en", "a b c"), ("en", "B a d")] * 10 + [("en", "q q q")] * 10
    assert got(C.collocations(docs(spark, rows))) == plain(rows)


def test_odd_rows(spark):
    long = "lorem ipsum dolor " * 40_000
    rows = [(None, None, 1, "x"), ("und", "a b " * 12, 2, None), (None, "a b " * 3, 2, "y"), ("en", "", 3, "x"), ("en", " .\n", 3, "x"), ("fr", long, 4, "z")]
    df = docs(spark, rows, "lang string, text string, rank int, part string")
    assert got(C.collocations(df)) == plain([r[:2] for r in rows])


def test_empty_table(spark):
    assert C.collocations(docs(spark, [])).count() == 0
    assert C.collocations(docs(spark, [("en", "one two")])).count() == 0
