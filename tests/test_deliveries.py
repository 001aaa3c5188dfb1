"""Stored results, footers, schemas from the data, changed values."""
import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pliego.operators.reshape import drop_all_null, flatten_variant, variant_leaves
from pliego.operators.scoring import LogisticModel, changed_values
from pliego.sources.footers import drop_null_columns, null_columns
from pliego.sources.sinks import export_csv, write_partitions


def test_rewritten_partition_replaces_itself_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(k, 2020 + k % 3, k * 1.5) for k in range(30)], "k int, Year int, v double")
    write_partitions(rows, path, ["Year"])
    write_partitions(rows.where("Year = 2021 AND k < 10").withColumn("v", -F.col("v")), path, ["Year"])
    got = {(r.k, r.Year): r.v for r in spark.read.parquet(path).collect()}
    want = {(r.k, r.Year): -r.v if r.Year == 2021 else r.v for r in rows.collect() if r.Year != 2021 or r.k < 10}
    assert got == want
    write_partitions(rows.limit(0), path, ["Year"])
    assert spark.read.parquet(path).count() == len(want)


def test_footers_settle_plain_columns_without_a_scan(spark, tmp_path):
    schema = ("k int, none string, some double, tag array<string>, none_tags array<string>, nulls_in array<string>, no_tags array<string>, "
              "s struct<a:int,b:string>, no_s struct<a:int>, s_of_nulls struct<a:int>, v variant, no_v variant")
    df = spark.range(40).select(
        F.col("id").cast("int").alias("k"), F.lit(None).cast("string").alias("none"), F.when(F.col("id") == 7, 1.0).alias("some"),
        F.array(F.lit("x")).alias("tag"), F.lit(None).cast("array<string>").alias("none_tags"), F.array(F.lit(None).cast("string")).alias("nulls_in"),
        F.array().cast("array<string>").alias("no_tags"), F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b")).alias("s"),
        F.lit(None).cast("struct<a:int>").alias("no_s"), F.struct(F.lit(None).cast("int").alias("a")).alias("s_of_nulls"),
        F.parse_json(F.lit("{}")).alias("v"), F.lit(None).cast("variant").alias("no_v"))
    assert df.columns == [c.split()[0] for c in schema.split(", ")]
    path = str(tmp_path / "t")
    df.repartition(3).write.parquet(path)
    empty, scanned = null_columns(spark, path)
    stored = spark.read.parquet(path)
    assert empty == ["none", "none_tags", "no_s", "no_v"]
    assert set(scanned) <= {"none_tags", "nulls_in", "no_tags", "no_s", "s_of_nulls", "tag"} and "none" not in scanned and "no_v" not in scanned
    assert drop_null_columns(spark, path).columns == drop_all_null(stored).columns


def test_files_without_null_counts_are_scanned(spark, tmp_path):
    t = pa.table({"a": pa.array([None, None], pa.string()), "b": pa.array([1, None], pa.int32())})
    pq.write_table(t, tmp_path / "x.parquet", write_statistics=False)
    pq.write_table(t, tmp_path / "y.parquet")
    assert null_columns(spark, str(tmp_path)) == (["a"], ["a", "b"])


def test_empty_and_partitioned_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 5)], "p int, a string, b int")
    df.write.partitionBy("p").parquet(str(tmp_path / "p"))
    assert drop_null_columns(spark, str(tmp_path / "p")).columns == ["b", "p"]
    df.limit(0).write.parquet(str(tmp_path / "e"))
    assert drop_null_columns(spark, str(tmp_path / "e")).columns == []


def test_fields_that_nobody_declared_are_columns(spark):
    docs = [{"id": "a", "tender": {"value": 5, "new field": True, "it's": 1.5}, "list": [{"x": 1}], "gone": None},
            {"id": 7, "tender": {"value": 6}, "list": None}, {}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "j string").select(F.parse_json("j").alias("r"))
    flat = flatten_variant(df, "r")
    assert sorted(flat.columns) == ["gone", "id", "list", "tender.it's", "tender.new field", "tender.value"]
    rows = [r.asDict() for r in flat.collect()]
    assert [r["tender.value"] for r in rows] == [5, 6, None] and rows[0]["tender.new field"] is True and rows[0]["tender.it's"] == 1.5
    assert [r["list"] for r in rows] == ['[{"x":1}]', None, None] and [r["id"] for r in rows] == ['"a"', "7", None]
    assert flatten_variant(df.limit(0), "r").columns == [] == flatten_variant(df.where("false"), "r").columns


def test_variant_schema_paths():
    text = "OBJECT<a: OBJECT<`x, y`: DECIMAL(4,2), `q``: z`: ARRAY<OBJECT<k: STRING>>>, b: VOID>"
    assert variant_leaves(text) == [(["a", "x, y"], "DECIMAL(4,2)"), (["a", "q`: z"], "ARRAY<OBJECT<k: STRING>>"), (["b"], "VOID")]


def test_only_changed_values_come_back(spark):
    a = spark.createDataFrame([("x", 1.0, None, 3), ("y", 1.0, 2.0, 3), ("z", 5.0, 5.0, 5)], "ocid string, u double, v double, w int")
    b = spark.createDataFrame([("x", 1.0, 2.0, 4), ("y", 1.0, 2.0, 3), ("q", 5.0, 5.0, 5)], "ocid string, u double, v double, w int")
    got = sorted(map(tuple, changed_values(a, b, cols=["u", "v", "w"]).collect()))
    assert got == [("x", "v", None, 2.0), ("x", "w", 3.0, 4.0)]


def test_csv_with_quotes_and_breaks_comes_back(spark, tmp_path):
    df = spark.createDataFrame([('say "x"', ['a"b\\', "c,d"]), (None, None)], "k string, arr array<string>")
    export_csv(df, str(tmp_path / "c"), escape='"')
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()
    assert {(r.k, r.arr and tuple(json.loads(r.arr))) for r in back} == {('say "x"', ('a"b\\', "c,d")), (None, None)}


def test_linear_model_has_its_own_threshold():
    m = LogisticModel([1.0, -1.0], 0.0, [0.5, 0.0], 0.4)
    X = np.array([[0.0, 0.3], [np.nan, 0.0], [-9.0, 0.0]])
    assert m.predict(X).tolist() == [1, 1, 0] and m.predict_proba(X)[0, 1] < .5


def test_model_table_scores_as_the_python_model(spark):
    from pliego.operators.scoring import FEATURES, TreeEnsembleModel, ensemble_from_table, score
    from pliego.plans.views import model_table
    nodes = ensemble_from_table(model_table(spark, FEATURES))
    assert len(nodes) == 12_700
    from pliego.plans.flows import scoring_features
    from pliego.plans.views import enquiry_view, tender_view
    f = scoring_features(tender_view(spark, SF_SMALL), enquiry_view(spark, SF_SMALL))
    rows = score(f, nodes).collect()
    X = np.array([[np.nan if r[c] is None else r[c] for c in FEATURES] for r in rows])
    assert np.allclose([r.proba for r in rows], TreeEnsembleModel(nodes).predict_proba(X)[:, 1]) and len({round(r.proba, 6) for r in rows}) > 20
