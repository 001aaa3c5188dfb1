"""The queries that SQL can express equal it."""
import duckdb
import pytest

from pliego.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    cur = con.execute(ORACLE[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = [tuple(r[k] for k in at) for r in cur.fetchall()]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*cols).collect()) and want


def test_all_operators_and_the_pipeline():
    assert [q.split("_")[0] for q in sorted(QUERIES, key=lambda q: (len(q.split("_")[0]), q))] == [*(f"op{n}" for n in range(1, 14)), "pipeline"]
