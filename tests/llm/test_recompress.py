"""Substring dedup against a count of all windows."""
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pliego.llm import recompress as R


def plain(texts, window):
    """[(words, removed, digest)] by counting every window."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for k in range(i, i + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = sorted(R.substring_dedup(df).collect())
    return [(r.n_words, r.n_removed, r.kept_sha256) for r in rows]


words = st.lists(st.sampled_from(["a", "b", "c"]), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(words, min_size=1, max_size=5), st.integers(2, 12), st.integers(0, 5), st.integers(1, 4))
def test_equal_windows_have_equal_anchors(lists, window, rounds, every):
    old = R.WINDOW, R.ROUNDS, R.RUNS_EVERY
    R.WINDOW, R.ROUNDS, R.RUNS_EVERY = window, rounds, every
    try:
        symbols, counts, start = R.word_hashes([" ".join(x).encode() for x in lists])
        assert counts.tolist() == [len(x) for x in lists]
        text, lo, hi, left, right, key = R.anchors(symbols, counts, start)
        seen, n = {}, 0
        for t, a, b, x, y, k in zip(text.tolist(), lo.tolist(), hi.tolist(), left.tolist(), right.tolist(), key.tolist()):
            for w in range(a, b + 1):
                assert w <= x < y <= w + window
                at = w - int(start[t])
                own = (x - w, y - w, k)
                assert seen.setdefault(tuple(lists[t][at:at + window]), own) == own
                n += 1
        assert n == sum(max(0, len(x) - window + 1) for x in lists)
    finally:
        R.WINDOW, R.ROUNDS, R.RUNS_EVERY = old


@pytest.mark.parametrize("window,seed", [(35, 1), (35, 2), (6, 3)])
def test_equals_count_of_windows(spark, monkeypatch, window, seed):
    monkeypatch.setattr(R, "WINDOW", window)
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(30)]

    def some(n):
        return rng.choice(vocabulary, n).tolist()
    passage, line = some(70), some(36)
    texts = []
    for i in range(60):
        w = some(int(rng.integers(0, 120)))
        if i % 3 == 0:
            a, b = sorted(rng.integers(0, 71, 2))
            w += passage[a:b] + some(5)
        if i % 7 == 0:
            w += line + some(3) + line
        if i % 10 == 0:
            w += ["x"] * int(rng.integers(30, 90)) + ["p", "q"] * int(rng.integers(15, 50))
        texts.append(" \t\n"[i % 3].join(w))
    texts += texts[:8]  # exact copies
    texts += [t[:-3] + "z" for t in texts[:8]]  # near copies
    assert found(spark, texts) == plain(texts, window)


def test_odd_rows(spark):
    base = " ".join(f"v{i}" for i in range(50))
    rows = [(1, None, "x"), (2, "", "x"), (3, base, "x"), (3, base, "x"), (3, "other " + base, "y"), (None, base + " end", None), (4, "one two", "x"),
            (5, " ".join(f"u{i}" for i in range(30000)), "x"), (None, None, "x"), (6, "é  b " * 40, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in R.substring_dedup(df).collect())
    assert got == sorted((d or 0, *p) for (d, _, _), p in zip(rows, plain([t for _, t, _ in rows], 35)))
    assert R.substring_dedup(df.limit(0)).count() == 0


def test_whole_table_equals_brute_force(spark, sf_dir):
    from pliego.llm.queries import QUERIES
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op9_substring_dedup"](spark, sf_dir).collect()}
    want = plain([d.text for d in docs], 35)
    assert got == {d.doc_id: w for d, w in zip(docs, want)} and any(w[1] for w in want)
