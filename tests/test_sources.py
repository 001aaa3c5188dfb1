"""Landing and the package layouts."""
import datetime
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq

from conftest import SF_SMALL
from pliego.plans.packages import indicators_from_packages
from pliego.sources.landing import land
from pliego.sources.ocds import read_package_lines, read_packages, read_zipped_packages, releases
from pliego.sources.schema import package_schema


def test_layouts_hold_the_same_releases(spark, tmp_path):
    n = None
    for layout, reader in (("lines", read_package_lines), ("package", read_packages), ("zip", read_zipped_packages)):
        out = land(spark, SF_SMALL, layout, out_dir=str(tmp_path / layout), releases_per_file=400)
        ids = sorted(r.ocid for r in releases(reader(spark, out)).select("ocid").collect())
        n = n or ids
        assert ids == n and len(ids) > 0


def test_large_tenders_stay_whole(spark, tmp_path):
    """A tender with 3,005 bids and one with 3,005 questions: every package query equals its SQL."""
    import shutil

    import duckdb
    import __spark_entry__ as E
    from pyspark.sql import functions as F
    for name in os.listdir(SF_SMALL):
        if name.split(".")[0] not in ("lineitem", "conversations"):
            shutil.copy(f"{SF_SMALL}/{name}", tmp_path)
    t = spark.read.parquet(f"{SF_SMALL}/orders.parquet").where("o_orderpriority = '1-URGENT'")
    bid_key, talk_key = [r[0] for r in t.select("o_orderkey").orderBy("o_orderkey").limit(2).collect()]
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    more = li.limit(1).withColumn("l_orderkey", F.lit(bid_key)).withColumn("l_partkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3004).cast("long"))))
    li.where(F.col("l_orderkey") != bid_key).unionByName(more.select(*li.columns)).write.parquet(str(tmp_path / "lineitem.parquet"))
    talk = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    turns = spark.range(6010).select(F.lit(talk_key).alias("conv_id"), F.col("id").alias("turn"),
                                     F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("some words").alias("text"))
    talk.where(F.col("conv_id") != talk_key).unionByName(turns).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    for name in ("orders", "lineitem", "conversations"):
        p = tmp_path / f"{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else
                f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}')")
    for q in ("ocds_red_flags", "ocds_features", "ocds_score", "parquet_red_flags", "scan_lines", "scan_package", "scan_zip", "view_sql"):
        df = E.queries()[q](spark, str(tmp_path))
        cols = sorted(df.columns)
        want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({E.oracle_sql()[q]})").fetchall()
        got = [tuple(r) for r in df.select(*cols).collect()]
        key = cols.index("ocid")
        assert len(got) == len(want), q
        for a, b in zip(sorted(got, key=lambda r: r[key]), sorted(want, key=lambda r: r[key])):
            assert all(x == y or isinstance(x, float) and abs(x - y) < 1e-6 * max(1, abs(x)) for x, y in zip(a, b)), (q, a, b)


def test_csv_export_keeps_nested_as_json(spark, tmp_path):
    from pliego.sources.sinks import export_csv
    df = spark.createDataFrame([("a", [1, 2], {"x": 1})], "k string, arr array<int>, m map<string,int>")
    export_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert back.k == "a" and back.arr == "[1,2]" and back.m == '{"x":1}'


def test_zip_landing_to_a_file_uri(spark, tmp_path):
    out = land(spark, SF_SMALL, "zip", out_dir="file:" + str(tmp_path / "z"))
    assert releases(read_zipped_packages(spark, out)).count() > 0


def test_write_table_partitions_by_year(spark, tmp_path):
    from pliego.sources.sinks import write_table
    import __spark_entry__ as E
    df = E.queries()["tender_year"](spark, SF_SMALL)
    write_table(df, str(tmp_path / "t"), partition_by=["Year"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == df.count()
    one = back.where("Year = 1998")
    assert "PartitionFilters: [isnotnull(Year" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == df.where("Year = 1998").count()


def test_zipped_releases(spark, tmp_path):
    """Few large archives give the releases of the packages; a broken one is named."""
    import pytest
    from pliego.sources.ocds import read_zipped_releases
    out = land(spark, SF_SMALL, "zip", out_dir=str(tmp_path / "z"), releases_per_file=10**6)
    want = releases(read_zipped_packages(spark, out))
    got = read_zipped_releases(spark, out)
    assert got.columns == want.columns
    assert sorted(map(str, got.select("ocid", "tender.enquiries", "auctions").collect())) == sorted(
        map(str, want.select("ocid", "tender.enquiries", "auctions").collect()))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "broken.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="broken.zip"):
        read_zipped_releases(spark, str(tmp_path / "bad")).count()


def test_csv_ready_is_the_whole_table(spark, tmp_path):
    """All columns of the projection, nested ones whole as JSON text, as its SQL has them."""
    import duckdb
    import __spark_entry__ as E
    from pliego.sources.ocds import indicator_projection
    day = datetime.datetime(2020, 5, 4, 3)
    tables = {
        "orders": [("o_orderkey", [1, 2]), ("o_custkey", [8, 9]), ("o_orderstatus", ["O", "P"]), ("o_totalprice", [100.5, 7.25]),
                   ("o_orderdate", pa.array([day, day], pa.timestamp("us"))), ("o_orderpriority", ["1-URGENT", "2-HIGH"])],
        "lineitem": [("l_orderkey", [1, 1, 1]), ("l_partkey", [7, 5, 6]), ("l_suppkey", [3, None, 4]), ("l_linenumber", pa.array([2, 1, 2], pa.int32())),
                     ("l_quantity", [1.0] * 3), ("l_extendedprice", [10.75, 20.0, None]), ("l_discount", [.0] * 3), ("l_tax", [.0] * 3),
                     ("l_returnflag", ["N"] * 3), ("l_linestatus", ["O"] * 3), ("l_shipdate", pa.array([day, day, None], pa.timestamp("us")))],
        "conversations": [("conv_id", [1, 1, 1]), ("turn", [2, 0, 1]), ("role", ["user", "user", "assistant"]), ("text", ["b\nc", 'say "a"', "yes"])]}
    con = duckdb.connect()
    for name, columns in tables.items():
        pq.write_table(pa.table(dict(columns)), tmp_path / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    df = E.queries()["csv_ready"](spark, str(tmp_path))
    assert df.columns == indicator_projection(spark.createDataFrame([], package_schema())).columns
    one, two = df.orderBy("id").collect()
    assert [b["id"] for b in json.loads(one.bids)] == ["1-1-5", "1-2-6", "1-2-7"]
    assert [(q["id"], q["description"], q.get("answer")) for q in json.loads(one.enquiries)] == [("0", 'say "a"', "yes"), ("2", "b\nc", None)]
    assert [json.loads(one[c]) for c in ("enq_desc", "enq_ans")] == [['say "a"', "b\nc"], ["yes", None]]
    assert two.bids is None and two.enquiries is None and (two.Tvalue, two.tag, two.parties) == (7.25, '["tender"]', "[null]")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({E.oracle_sql()['csv_ready']}) ORDER BY id").fetchall()
    assert [tuple(one), tuple(two)] == want
