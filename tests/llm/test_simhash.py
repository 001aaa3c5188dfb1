"""SimHash near-dedup against a plain version: majority bits, all pairs, union-find."""
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from pliego.llm import simhash as S


def plain_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(rows, radius):
    """rows: (doc_id, fp) -> {doc_id: smallest doc_id reachable}."""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for n, (a, x) in enumerate(rows):
        for b, y in rows[:n]:
            if (x ^ y).bit_count() <= radius:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: find(d) for d, _ in rows}


def test_fingerprint_rule():
    for t in [None, "", " \t\n", "One", "a b", "A B C", "ünï Ä a\x0bb\x0cc d", "x " * 500, "a b c d e f"]:
        assert S.fingerprint(t) == plain_fingerprint(t)


def test_long_text_in_parts(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(999))
    monkeypatch.setattr(S, "AT_ONCE", 10)
    assert S.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("n,radius", [(1, 2), (40, 2), (300, 2), (300, 1), (300, 3), (200, 6)])
def test_bit_planes_equal_popcount(n, radius):
    rng = np.random.default_rng(n + radius)
    base = rng.integers(0, 2**63, 5, np.uint64)
    fps = base[rng.integers(0, 5, n)]
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n, np.uint64))
    want = {(i, j) for i in range(n) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
    x, y = S.link_small(fps, np.zeros(n, int), radius)
    assert {(max(a, b), min(a, b)) for a, b in zip(x.tolist(), y.tolist())} == want
    x, y = S.link_large(fps, radius)
    got = {(max(a, b), min(a, b)) for a, b in zip(x.tolist(), y.tolist())}
    assert got <= want
    rows = list(zip(range(n), map(int, fps)))
    direct = plain_groups(rows, radius)
    spanned = {d: d for d in range(n)}

    def find(v):
        while spanned[v] != v:
            v = spanned[v]
        return v
    for a, b in got:
        lo, hi = sorted((find(a), find(b)))
        spanned[hi] = lo
    assert {d: find(d) for d in range(n)} == direct


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")


def test_whole_table_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    fps = {d: plain_fingerprint(t) for d, t in rows}
    want = plain_groups(list(fps.items()), 2)
    from pliego.llm.queries import QUERIES
    got = QUERIES["op8_simhash"](spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fps[d]:016x}", want[d]) for d in fps}
    assert len(got) == len(rows)


def test_chain_of_links_and_chunked_buckets(spark, monkeypatch):
    """A chain 0-1-2-... is one group although its ends are far apart; chunking changes nothing."""
    fp, reps = 0, []
    for i in range(30):
        reps.append((S.signed(fp), 100 - i))
        fp ^= 0b11 << 2 * i
    e = spark.createDataFrame(reps, "fp long, rep long")
    for bucket in (S.BUCKET, 2):
        monkeypatch.setattr(S, "BUCKET", bucket)
        comp = {r.node: r.root for r in S.components(S.links(e, 2)).collect()}
        assert set(comp.values()) == {71} and len(comp) == 29


def test_odd_rows(spark):
    rows = [(3, None, "x", 1), (1, "", None, 2), (2, "  ", "x", 3), (None, "", "x", 4), (7, "a b c d", "y", 5),
            (7, "a b c d", "y", 5), (9, "A B  C d", "z", 6), (7, "other words here entirely", "y", 5)]
    g = S.simhash_groups(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in g if r.doc_id is not None) == [(1, 1), (2, 1), (3, 1), (7, 7), (7, 7), (7, 7), (9, 7)]
    assert [r.component_id for r in g if r.doc_id is None] == [None]
    kept = S.simhash_dedup(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 7), (True, 0)]


def test_empty_table(spark):
    assert S.simhash_groups(docs(spark, [])).count() == 0
    assert S.simhash_dedup(docs(spark, [])).count() == 0
