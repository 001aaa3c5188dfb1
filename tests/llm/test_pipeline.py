"""The pipeline against the operators' plain versions, stage by stage."""
import re

import pytest

import corpus_pipeline
from pliego.llm import pieces as P

from . import test_decontaminate as deco
from . import test_pieces as piece
from . import test_pii as pii_test
from . import test_simhash as sim


def plain_redacted(text):
    from pliego.llm.pii import KINDS, anchors, find_spans
    spans = find_spans(text, anchors())
    base = pii_test.plain(text)
    assert {k: spans[k] for k in base} == base
    marks = sorted((s, -e, k) for k in KINDS for s, e in spans[k])
    out, pos = "", 0
    for s, e, k in marks:
        if s >= pos:
            out += text[pos:s] + f"<{k.upper()}>"
            pos = -e
        else:
            pos = max(pos, -e)
    return out + text[pos:]


def test_run_equals_plain_version(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs = [(d, t) for d, t in docs if t and re.search(r"[^\W\d_]", t)]
    groups = sim.plain_groups([(d, sim.plain_fingerprint(t)) for d, t in docs], 2)
    docs = [(d, t) for d, t in docs if groups[d] == d]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = {d for d, _ in deco.plain(docs, items)}
    docs = {d: plain_redacted(t) for d, t in docs if d not in dirty}
    vocab = P.Vocabulary.read()
    score, memo = piece.table(vocab), {}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for d, t in docs.items():
        want = []
        for u in P.units(t):
            if u not in memo:
                memo[u] = piece.plain(u, vocab, score)
            want += memo[u]
        assert got[d].ids == want and got[d].round_trip


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "s", 0)], [(None, "", None, None, None), (2, "the end", "en", "s", 7), (2, "the end", "en", "s", 7)]])
def test_small_tables(spark, sf_dir, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in got] == ([2] if len(rows) == 3 else [])


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("n_chars", "Fp")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "Fp"]
