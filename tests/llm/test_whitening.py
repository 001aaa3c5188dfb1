"""Whitening against a plain version: integers in Python, numpy's eigenvectors."""
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from pliego.llm import whitening as W


def plain(rows, top=8):
    """{(row number, component): (n, deviation, whitened, explained)} with the sign of a component's largest entry positive."""
    x = [[floor(1024 * c) + 100000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    centred = np.array([[(n * r[j] - s[j]) / n for j in range(d)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for k in range(min(top, d)):
        v = vectors[:, d - 1 - k]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        for i in range(n):
            out[i, k + 1] = (n, sum((n * x[i][j] - s[j]) ** 2 for j in range(d)), centred[i] @ v / values[d - 1 - k] ** .5,
                             values[d - 1 - k] / values.sum())
    return out


def det(m):
    m = [[Fraction(int(x)) for x in r] for r in m]
    out = Fraction(1)
    for k in range(len(m)):
        at = next((r for r in range(k, len(m)) if m[r][k]), None)
        if at is None:
            return 0
        if at != k:
            m[k], m[at], out = m[at], m[k], -out
        out *= m[k][k]
        for r in range(k + 1, len(m)):
            f = m[r][k] / m[k][k]
            m[r] = [a - f * b for a, b in zip(m[r], m[k])]
    return out


def scattered(y):
    y = np.array(y).astype(object)
    return len(y) * y.T.dot(y) - np.outer(y.sum(0), y.sum(0))


@pytest.mark.parametrize("kind", ["full", "low rank", "diagonal", "zeros"])
def test_polynomial_is_the_determinant(spark, kind):
    rng = np.random.default_rng(4)
    y = rng.integers(-10 ** 6, 10 ** 6, (40, 7))
    if kind == "low rank":
        y = y[:, :3] @ rng.integers(-5, 5, (3, 7))
    a = scattered(y)
    if kind == "diagonal":
        a = np.diag(np.array([5, 5, 5, 9, 9, 1, 0], object))
    if kind == "zeros":
        a = a * 0
    c = W.characteristic_polynomial(spark, a)
    for t in (-3, 0, 1, 10 ** 9):
        assert sum(x * t ** k for k, x in enumerate(c)) == det(np.eye(7, dtype=int) * t - a)


def test_roots_with_multiplicity():
    poly = [1]
    for r in [3, 3, 3, 7, 100, 0, 0, 12, 12]:
        poly = [(poly[k - 1] if k else 0) - r * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    for x, n in [(0, 7), (3, 4), (2, 7), (7, 3), (99, 1), (100, 0), (12, 1)]:
        assert W.roots_over(poly, x, 0) == n == W.roots_over(poly, 8 * x, 3)
    roots, shift = W.leading_roots(poly, 20, 140)
    assert [(round(r / 2 ** shift, 12), m) for r, m in roots] == [(100, 1), (12, 2), (7, 1), (3, 3)]


def test_large_entries_stay_exact():
    rng = np.random.default_rng(2)
    for top in (1000, 1 << 25, 1 << 40):
        y = rng.integers(-top, top, (500, 5))
        assert (W.product_sums(y) == y.astype(object).T.dot(y.astype(object))).all()


def table(spark, rows, schema="vec_id long, embedding array<float>"):
    return spark.createDataFrame(rows, schema)


def check(df, vectors, ids, top=8):
    want = plain(vectors, top)
    got = df.collect()
    assert len(got) == len(want)
    at = {i: k for k, i in enumerate(ids)}
    for r in got:
        n, dev, white, share = want[at[r.vec_id], r.component]
        assert (r.n, int(r.deviation)) == (n, dev)
        assert abs(r.whitened - white) < 1e-7 * max(1, abs(white)) and abs(r.explained / share - 1) < 1e-9
        assert r.identity_error < 1e-9


def test_whole_table_equals_numpy(spark, sf_dir):
    from pliego.llm.queries import QUERIES
    rows = [r for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
            if r.embedding is not None and all(c is not None and isfinite(c) for c in r.embedding)]
    df = QUERIES["op12_whitening"](spark, sf_dir)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
                               "whitened": "double", "explained": "double", "identity_error": "double"}
    check(df, [r.embedding for r in rows], [r.vec_id for r in rows])


def test_fewer_dimensions_than_components(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(0, 2, (60, 3)) @ rng.normal(0, 1, (3, 3))
    check(W.whiten(table(spark, [(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")), v.tolist(), range(60))


def test_multiple_eigenvalue(spark):
    """All of +-e_i: one eigenvalue four times; any basis whitens."""
    rows = [(i, [float(s) if j == i // 2 else 0.0 for j in range(4)]) for i, s in enumerate([1, -1] * 4)]
    got = W.whiten(table(spark, rows)).collect()
    assert len(got) == 32 and all(r.identity_error < 1e-12 and abs(r.explained - .25) < 1e-15 for r in got)


def test_rank_and_large_values(spark):
    """Rank 1 has one component; entries far over 2 ** 26 take the exact path."""
    rows = [(i, [float(i), 2.0 * i, -1e6 * i, 7.0]) for i in range(30)]
    got = W.whiten(table(spark, rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 30 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    x = [[floor(1024 * c) + 100000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in got} == {i: sum((30 * a - b) ** 2 for a, b in zip(x[i], s)) for i in range(30)}
    assert got[0].identity_error < 1e-10


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    good = [[float(x) for x in rng.normal(0, 1, 4)] for _ in range(12)]
    rows = [(i, v, "x", 1) for i, v in enumerate(good)] + [
        (100, None, "x", 1), (101, [1.0, None, 2.0, 3.0], "x", 1), (102, [nan, 1.0, 2.0, 3.0], "x", 1), (103, [inf, 1.0, 2.0, 3.0], "x", 1),
        (104, [-inf, 1.0, 2.0, 3.0], "x", 1), (105, [], "x", 1), (106, [1.0], "x", 1), (3, good[3], "x", 1), (None, good[0], "x", 1)]
    got = W.whiten(table(spark, rows, "vec_id long, embedding array<double>, n string, component int")).collect()
    ids = [r.vec_id for r in got if r.component == 1]
    assert sorted(i for i in ids if i is not None) == sorted([*range(12), 3]) and ids.count(None) == 1 and {r.n for r in got} == {14}
    assert len(got) == 14 * 4


def test_no_components(spark):
    assert W.whiten(table(spark, [])).count() == 0
    assert W.whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert W.whiten(table(spark, [(1, None), (2, [])])).count() == 0
