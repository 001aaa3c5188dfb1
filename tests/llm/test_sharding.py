"""Extendible hashing against a plain bucket splitter."""
import hashlib

import pytest

from pliego.llm import sharding as S

F = S.F


def bits(x):
    return "".join(f"{b:08b}" for b in hashlib.md5(str(x).encode()).digest())


def plain(rows, limit):
    """{row: shard} for unique keys by splitting oversized buckets on the next bit."""
    out, todo = {}, [("", rows)]
    while todo:
        p, own = todo.pop()
        if sum(b for _, b in own) <= limit or len(own) == 1:
            out |= {k: p for k, _ in own}
            continue
        for bit in "01":
            part = [(k, b) for k, b in own if bits(k)[len(p)] == bit]
            if part:
                todo.append((p + bit, part))
    return out


def sharded(spark, rows, limit, schema="k long, b long"):
    return S.extendible_shards(spark.createDataFrame(rows, schema), "k", F.col("b"), limit)


@pytest.mark.parametrize("limit,finer", [(1, 6), (100, 6), (100, 1), (5000, 6), (10**9, 6)])
def test_equals_bucket_splitting(spark, monkeypatch, limit, finer):
    monkeypatch.setattr(S, "FINER", finer)
    rows = [(i, 1 + i * i % 37) for i in range(150)]
    got = sharded(spark, rows, limit).collect()
    want = plain(rows, limit)
    assert {r.k: r.shard for r in got} == want and len(got) == len(rows)
    for r in got:
        own = [b for k, b in rows if want[k] == r.shard]
        assert (r.depth, r.part, r.shard_rows, r.shard_bytes) == (len(r.shard), 0, len(own), sum(own))


def fits(got, limit):
    sizes = {}
    for r in got:
        sizes.setdefault((r.shard, r.part), []).append(r.b or 0)
    assert all(sum(v) <= limit or len(v) == 1 for v in sizes.values()), sizes
    return sizes


def test_hot_keys_equal_rows_and_large_rows(spark):
    rows = [(7, 10, f"t{i}") for i in range(80)] + [(8, 10, "same")] * 100 + [(9, 500, "big")] + [(None, 3, None)] * 50 + [(5, None, "x")]
    got = sharded(spark, rows, 45, "k long, b long, t string").collect()
    assert sorted((str(r.k), str(r.b), str(r.t)) for r in got) == sorted((str(a), str(b), str(c)) for a, b, c in rows)
    sizes = fits(got, 45)
    assert len({s for s in sizes if s[1] > 0}) >= 20
    chain = {r.part for r in got if r.k == 8}
    assert chain == set(range(25))


def test_extra_columns_empty_table_and_write(spark, tmp_path):
    df = spark.createDataFrame([(i, 10, "x", 1) for i in range(20)], "k long, b long, shard string, Part int")
    out = S.extendible_shards(df, "k", F.col("b"), 50)
    assert out.columns == ["k", "b", "shard", "depth", "part", "shard_rows", "shard_bytes"]
    assert S.extendible_shards(df.limit(0), "k", F.col("b"), 50).count() == 0
    S.write_shards(out, str(tmp_path / "out"))
    back = spark.read.schema("k long, b long, shard string, part long").parquet(str(tmp_path / "out"))
    assert sorted((r.k, r.shard) for r in back.collect()) == sorted((r.k, r.shard) for r in out.collect())


def test_only_built_in_functions(spark, sf_dir):
    from pliego.llm.queries import QUERIES
    plan = QUERIES["op6_sharding"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_writes_whole_documents(spark, sf_dir, monkeypatch):
    from pliego.llm.queries import QUERIES
    paths, write = [], S.write_shards
    monkeypatch.setattr(S, "write_shards", lambda df, path: (paths.append(path), write(df, path)))
    got = QUERIES["op6_sharding"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = spark.read.parquet(paths[0]).select(*docs.columns)
    assert back.exceptAll(docs).isEmpty() and docs.exceptAll(back).isEmpty()
    assert got.inputFiles() and all(f"{paths[0].rsplit('/', 1)[1]}/shard=" in p for p in got.inputFiles())


def test_single_shard_reads_back(spark, tmp_path):
    out = sharded(spark, [(1, 5), (2, 6)], 100)
    S.write_shards(out, str(tmp_path / "one"))
    assert sorted(map(tuple, S.read_shards(spark, str(tmp_path / "one"), out.schema).collect())) == [(1, 5, "", 0, 0, 2, 11), (2, 6, "", 0, 0, 2, 11)]
    S.write_shards(out.limit(0), str(tmp_path / "none"))
    assert S.read_shards(spark, str(tmp_path / "none"), out.schema).count() == 0
