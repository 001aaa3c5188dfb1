"""Segmentation-marginalised unigrams against enumeration, and held-out accuracy."""
import zlib

import numpy as np
import pytest

from pliego.llm import langid as L

PIECES = sorted(["a", "b", "ab", "aba", "ba", "▁", "▁a", "▁ab", "▁abab", "c"])


def segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, min(len(word), L.MAX_PIECE) + 1):
        head = word[:k]
        if head in pieces or k == 1:
            for rest in segmentations(word[k:], pieces):
                yield [head, *rest]


def model_probs(seed=1, langs=3):
    p = np.random.default_rng(seed).random((len(PIECES) + 2, langs))
    p[-1] = 0
    return p / p.sum(axis=0)


def of(piece, probs):
    return probs[PIECES.index(piece) if piece in PIECES else len(PIECES)]


@pytest.mark.parametrize("word", ["▁abab", "▁", "a", "▁xax", "▁ababab", "zz", "▁cabac"])
def test_forward_sums_all_segmentations(word):
    probs = model_probs()
    want = sum(np.prod([of(p, probs) for p in s], axis=0) for s in segmentations(word, PIECES))
    got = np.exp(L.log_scores([word, word], L.Lattice(PIECES), probs))
    assert np.allclose(got, [want, want])


def test_expected_uses_equal_enumeration(spark):
    probs = model_probs(langs=2)
    rows = [("x", "▁abab", 3), ("y", "▁abab", 1), ("y", "▁xb", 2)]
    want = {}
    for lang, word, n in rows:
        k = "xy".index(lang)
        segs = [(s, np.prod([of(p, probs)[k] for p in s])) for s in segmentations(word, PIECES)]
        total = sum(w for _, w in segs)
        for s, w in segs:
            for p in s:
                key = (k, PIECES.index(p) if p in PIECES else len(PIECES))
                want[key] = want.get(key, 0) + n * w / total
    words = spark.createDataFrame(rows, "lang string, word string, n long")
    got = {(k, p): u for k, p, u in L.expected(spark, words, ["x", "y"], PIECES, probs)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_long_words_do_not_underflow():
    probs = np.full((len(PIECES) + 2, 2), 1e-8)
    probs[-1] = 0
    parts = L.segments("z" * 5000)
    assert "".join(parts) == "▁" + "z" * 5000
    assert np.isfinite(L.log_scores(parts, L.Lattice(PIECES), probs)).all()


def test_cache_limit_changes_nothing(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.fit(docs, per_language=20, rounds=1)
    texts = [r.text for r in docs.select("text").limit(40).collect()]
    want = model.scorer()(texts)
    monkeypatch.setattr(L, "CACHE", 50)
    score = model.scorer()
    assert [score([t])[0] for t in texts] == want


@pytest.fixture(scope="module")
def predicted(spark):
    from pliego.llm.queries import QUERIES
    return {r.doc_id: r for r in QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").collect()}


def test_held_out(spark, predicted):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text").collect()
    assert len(docs) == len(predicted)
    for d in docs:
        assert predicted[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)
        assert 0 <= predicted[d.doc_id].score <= 1
    seen = [d for d in docs if predicted[d.doc_id].held_out and d.lang]
    right = sum(predicted[d.doc_id].lang_pred == d.lang for d in seen)
    assert len(seen) > 150 and right / len(seen) > 0.97


def test_odd_rows(spark):
    rows = [(i, "der und die das ist " * 3, "de", 0.0) for i in range(30)] + [(100 + i, "the and of that is", "en", 0.0) for i in range(30)]
    odd = [(None, "the and", "en", 1.0), (200, None, "en", 1.0), (201, "", None, 1.0), (202, "123 -- 4_5", "de", 1.0),
           (203, "THE AND", None, 1.0), (203, "THE AND", None, 1.0), (204, "the " * 40000, None, 1.0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    model = L.fit(df)
    assert model.languages == ["de", "en"]
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in L.predict(df, model).collect()}
    assert got[None, "the and"][0] == "en" and got[203, "THE AND"][0] == "en"
    assert got[200, None] == got[201, ""] == got[202, "123 -- 4_5"] == ("und", 0.0)
    kept = L.accepted(df, model)
    assert kept.columns == df.columns and kept.count() == len(rows) + 4


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    model = L.fit(df)
    assert [(r.lang_pred, r.score) for r in L.predict(df, model).collect()] == [("und", 0.0)]
    assert L.accepted(df, model).count() == 1
    assert L.predict(df.limit(0), L.fit(df.limit(0))).count() == 0


def plain_scores(text, model):
    """Log-probabilities by language: every word's forward sum, segment by segment, with a dictionary of pieces."""
    from math import log
    number = {p: n for n, p in enumerate(model.pieces)}
    out = np.zeros(len(model.languages))
    for w in L.WORD.findall((text or "").lower()):
        whole = "▁" + w
        for k in range(0, len(whole), L.SEGMENT):
            part = whole[k:k + L.SEGMENT]
            alpha = [np.ones(len(model.languages))]
            for j in range(1, len(part) + 1):
                a = np.zeros(len(model.languages))
                for i in range(j):
                    n = number.get(part[i:j], len(model.pieces) if j - i == 1 else None)
                    if n is not None:
                        a = a + alpha[i] * model.probs[n]
                alpha.append(a)
            out += np.log(alpha[-1])
    return out


def test_whole_table_equals_plain_version(spark, sf_dir):
    """lang_pred and score of every document, by a plain forward algorithm over the same model."""
    from pliego.llm.queries import QUERIES
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.fit(docs.select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for r in rows:
        if not L.WORD.search(r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        total = plain_scores(r.text, model)
        best = int(np.argmax(total))
        assert abs(got[r.doc_id].score - 1 / np.exp(total - total[best]).sum()) < 1e-6
        assert got[r.doc_id].lang_pred == model.languages[best] or sorted(total)[-1] - sorted(total)[-2] < 1e-6


def test_every_letter_piece_counts():
    """Pieces of any length are in the model and in the sums."""
    pieces = L.read_pieces()
    assert max(map(len, pieces)) > 10 and len(pieces) > 20_000
    word = max(pieces, key=len)
    probs = np.full((len(pieces) + 2, 2), 1e-6)
    probs[-1] = 0
    more = probs.copy()
    more[pieces.index(word)] = .5
    lattice = L.Lattice(pieces)
    assert L.log_scores([word], lattice, more)[0, 0] > np.log(.49) > L.log_scores([word], lattice, probs)[0, 0]


def test_sample_is_the_lowest_of_the_hash_order(spark, monkeypatch):
    """Ranking in parts chooses the same documents as one window."""
    from pliego.llm import common
    from pyspark.sql import functions as F
    rows = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("lang"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    want = sorted(map(tuple, common.first_of_each(rows, "lang", "doc_id", order, 9, "n").collect()))
    monkeypatch.setattr(common, "RANKED", 20)
    assert sorted(map(tuple, common.first_of_each(rows, "lang", "doc_id", order, 9, "n").collect())) == want and len(want) == 27
