"""Three-phase top-k against all inner products."""
import math

import numpy as np
import pytest

from pliego.llm import topk as K


def plain(rows, k, every=20, scale=64):
    vs = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(scale * float(np.float32(x))) for x in v)
        vs[i] = min(q, vs.get(i, q))
    out = set()
    for a, x in vs.items():
        if a % every == 0:
            scored = sorted((-sum(p * q for p, q in zip(x, y)), b) for b, y in vs.items() if b != a and len(x) == len(y))
            out |= {(a, n + 1, b, -s) for n, (s, b) in enumerate(scored[:k])}
    return out


def found(spark, rows, k, every=20):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = K.topk_search(df, K.F.col("vec_id") % every == 0, k).collect()
    assert len({tuple(r) for r in got}) == len(got)
    return {tuple(r) for r in got}


@pytest.mark.parametrize("k,dim,blocks", [(20, 16, (4, 50)), (3, 5, (512, 16384)), (1, 1, (7, 13))])
def test_equals_all_products(spark, monkeypatch, k, dim, blocks):
    monkeypatch.setattr(K, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(K, "VECTOR_BLOCK", blocks[1])
    rng = np.random.default_rng(dim)
    rows = [(i, rng.normal(size=dim).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(60)]  # many equal vectors
    assert found(spark, rows, k) == plain(rows, k)


def test_ties_by_smaller_id(spark):
    rows = [(i, [float(i % 2), 1.0]) for i in range(90)]
    assert found(spark, rows, 20, every=5) == plain(rows, 20, every=5)


def test_odd_rows(spark):
    v = [0.5, -0.25, 1.0]
    rows = [(0, v), (0, v), (20, None), (40, [1.0, None, 2.0]), (60, [float("nan"), 1.0, 1.0]), (80, [float("inf"), 0.0, 0.0]),
            (None, v), (100, []), (120, []), (7, [1.0, 2.0]), (140, [3.0, 1.0]), (8, v), (9, [1e6, -1e6, 3.0]), (160, [0.0, 0.0, 0.0]),
            (180, [-1.0, 1.0, 1.0])]
    assert found(spark, rows, 20) == plain(rows, 20)
    huge = [(0, [3e37, -3e37]), (1, [3e37, 1.0]), (2, [-3e37, -3e37])]
    assert [r[:3] for r in sorted(found(spark, huge, 2))] == [(0, 1, 1), (0, 2, 2)]
    assert found(spark, [], 20) == set() and found(spark, [(1, v)], 20) == set() and found(spark, [(20, v)], 20) == set()


def test_extra_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 5, "a"), (1, [2.0], 6, "b")], "vec_id long, embedding array<double>, q int, score string")
    got = K.topk_search(df, K.F.col("vec_id") == 0, 20)
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 64 * 128)]


@pytest.mark.parametrize("size", [1.5e7, 3e7, 2e6])
def test_scores_near_the_end_of_a_long(spark, size):
    """Products of a list between 2 ** 61 and 2 ** 63, and lists past a long whose sum is not: exact."""
    rng = np.random.default_rng(int(size))
    rows = [(i, (size * rng.uniform(.9, 1.1, 8)).astype(np.float32).tolist()) for i in range(40)]
    want = plain(rows, 5)
    assert size != 1.5e7 or all(1 << 61 < r[3] < 1 << 63 for r in want)
    limit = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    assert found(spark, rows, 5) == {(a, n, b, limit(s)) for a, n, b, s in want}
    rows = [(i, [*(4 * size * rng.uniform(.9, 1.1, 4)).astype(np.float32).tolist(), *(-4 * size * rng.uniform(.9, 1.1, 4)).astype(np.float32).tolist()])
            for i in range(20)] + [(20, [x * y for x, y in zip([4 * size] * 8, [1, 1, 1, 1, 1, 1, 1, .99])])]
    assert found(spark, rows, 5) == {(a, n, b, limit(s)) for a, n, b, s in plain(rows, 5)}


def nodes(plan):
    """The physical plan's operators and the columns that they give."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    yield plan.nodeName(), {plan.output().apply(i).name() for i in range(plan.output().size())}
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_no_growing_table_goes_through_the_driver(spark, monkeypatch):
    """However small the tables look, joins shuffle: only keys of hot vectors (at most 400) are broadcast; pairs of blocks stay where they are made."""
    written, kept = K.written, []
    monkeypatch.setattr(K, "written", lambda df, name: kept.append(df) or written(df, name))
    monkeypatch.setattr(K, "QUERY_BLOCK", 4)
    monkeypatch.setattr(K, "VECTOR_BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = K.topk_search(df, K.F.col("vec_id") % 5 == 0, 3)
    stored, last = ([x for d in ds for x in nodes(d._jdf.queryExecution().executedPlan())] for ds in (kept, [found]))
    assert not [n for n, _ in stored if n.startswith("Broadcast")]
    assert all(out <= {"q", "found"} for n, out in last if n == "BroadcastExchange")
    assert not [out for n, out in [*stored, *last] if n == "Exchange" and {"queries", "vectors"} <= out]
    assert sum(n == "SortMergeJoin" for n, _ in stored) >= 8
    assert {tuple(r) for r in found.collect()} == plain(rows, 3, every=5)
