"""MinHash near-dedup against a plain version: whole sets, all pairs, union-find."""
import re

import numpy as np
import pytest

from pliego.llm import minhash as M


def plain_set(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < k:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i:i + k]) for i in range(len(words) - k + 1)}


def plain_groups(sets, percent):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    where = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    for a, s in sets.items():
        both = {}
        for g in s:
            for b in where[g]:
                if b < a:
                    both[b] = both.get(b, 0) + 1
        for b, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[b]) - n):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: find(d) for d in sets}


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def variants(n_groups, copies, words, changes, seed=0):
    """Groups of texts, each a copy of the one before or of the first with some words changed."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(n_groups):
        base = [f"w{x}" for x in rng.integers(0, 3000, words)]
        last = base
        for c in range(copies):
            t = list(last if c % 2 else base)
            for at in rng.integers(0, words, rng.integers(0, changes + 1)):
                t[at] = f"v{rng.integers(0, 10 ** 6)}"
            last = t
            out.append(" ".join(t))
    order = rng.permutation(len(out))
    return [(int(k), out[i]) for k, i in enumerate(order)]


def test_sets_and_sizes():
    for t in [None, "", " \t\n", "One", "a b", "A B C", "ünï Ä a\x0bb\x0cc d", "x " * 500, "a b c d e f a b c", "a b c d"]:
        assert len(M.shingle_set(t)) == len(plain_set(t))
    assert (M.shingle_set("A b C") == M.shingle_set("a  B\nc")).all()


def test_radius_is_the_binomial_tail():
    from math import comb
    r = M.radius(85)
    tail = lambda r: sum(comb(96, i) * .15 ** i * .85 ** (96 - i) for i in range(r + 1, 97))
    assert tail(r) <= 1e-9 < tail(r - 1) and M.radius(100) == 0


def test_codes_differ_as_the_similarity_says():
    rng = np.random.default_rng(5)
    far = []
    for _ in range(400):
        pool = rng.integers(0, 2 ** 63, 400, np.uint64)
        far.append((M.signature(np.sort(pool[:370])) != M.signature(np.sort(pool[30:]))).sum())
    far = np.array(far)  # similarity 340 / 400
    assert abs(far.mean() - .15 * 96) < .6 and abs(far.std() - (96 * .15 * .85) ** .5) < .5


@pytest.mark.parametrize("r", [0, 1, 6, 39])
def test_signatures_within_the_radius_share_a_key(r):
    """Any r errors leave a key in common; the errors are set as evenly as can be, the worst case."""
    rng = np.random.default_rng(r)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, 96).astype(np.uint16)
        b = a.copy()
        at = rng.permutation(96)[:r] if rng.random() < .5 else (np.arange(r) * 96 // max(r, 1) + rng.integers(0, 96)) % 96
        b[at] ^= 1
        ka, kb = M.chunk_keys(np.stack([a, b]), r)
        assert (ka == kb).any()


def test_same_chunks_give_the_same_keys_only():
    rng = np.random.default_rng(1)
    k = M.chunk_keys(rng.integers(0, 1 << 16, (2000, 96)).astype(np.uint16), 39)
    assert len(np.unique(k)) == k.size


def test_whole_table_equals_brute_force(spark, sf_dir):
    from pliego.llm.queries import QUERIES
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: plain_set(r.text) for r in rows}
    want = plain_groups(sets, 85)
    got = QUERIES["op11_minhash"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {d: (len(sets[d]), want[d], want[d] == d) for d in sets}


@pytest.mark.parametrize("bucket", [2048, 3])
def test_groups_and_chunks(spark, monkeypatch, bucket):
    """Chains of changed copies around the limit; small chunks change nothing."""
    monkeypatch.setattr(M, "BUCKET", bucket)
    rows = variants(12, 14, 80, 5) + [(1000 + k, t) for k, (_, t) in enumerate(variants(1, 40, 60, 3, 1))]
    want = plain_groups({d: plain_set(t) for d, t in rows}, 85)
    got = {r.doc_id: r.component_id for r in M.minhash_groups(docs(spark, rows)).collect()}
    assert got == want
    assert 5 < len(set(want.values())) < len(want) - 20


def test_limit_itself_counts(spark):
    """17 of 20 shingles are exactly 85 percent."""
    a = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(a[:20])), (2, " ".join(a[:19])), (5, " ".join(f"u{i}" for i in range(22))),
            (6, " ".join(f"u{i}" for i in range(19))), (7, " ".join(f"u{i}" for i in range(18)))]
    got = {r.doc_id: r.component_id for r in M.minhash_groups(docs(spark, rows)).collect()}
    assert got == plain_groups({d: plain_set(t) for d, t in rows}, 85) == {1: 1, 2: 1, 5: 5, 6: 5, 7: 5}


def test_odd_rows(spark):
    long = " ".join(f"n{i}" for i in range(60_000))
    rows = [(9, "A b", "x", 1), (3, "a  B", None, 2), (4, "", "x", 3), (5, None, "x", 3), (6, " \n", "x", 3), (None, "a b", "x", 1),
            (None, None, "x", 1), (7, "one two three four", "x", 1), (7, "one two three four", "x", 1), (8, "ONE two three four", "x", 1),
            (20, long, "x", 1), (21, long + " more", "x", 1), (7, "something else it is", "x", 1)]
    got = M.minhash_groups(docs(spark, rows, "doc_id long, text string, KEY string, rep int")).collect()
    assert sorted((r.doc_id, r.component_id, r.n_shingles) for r in got if r.doc_id is not None) == [
        (3, 3, 1), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 2), (7, 7, 2), (7, 7, 2), (8, 7, 2), (9, 3, 1), (20, 20, 59998), (21, 20, 59999)]
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]


def test_empty_table(spark):
    assert M.minhash_groups(docs(spark, [])).count() == 0
