"""Registered queries on stored results, schemas that the data have, and models of other kinds.

They write to the shared folder and read back, so what they return is what a
later reader of the files gets.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, VariantType

from ..operators.harvest import parse_fragments
from ..operators.reshape import flatten_variant
from ..operators.scoring import FEATURES, LogisticModel, changed_values, ensemble_from_table, score, score_with_model
from ..session import shared_dir
from ..sources.footers import drop_null_columns
from ..sources.landing import GZIP, landed
from ..sources.ocds import indicator_projection
from ..sources.sinks import csv_ready, export_csv, write_partitions
from .flows import scored_views, scoring_features
from .registry import _rounded, packages_of, register
from .views import TEST_METHOD, enquiry_view_and_hot, harvest_shapes_view, model_table, tender_view

# The projection's columns that are numbers; in a CSV file everything is text.
_DOUBLES = ("PreRefe", "Tvalue", "awardsvalue", "ContractValue")
_LONGS = ("n_of_Tend", "year")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, hot = enquiry_view_and_hot(spark, sf_dir)
    return scoring_features(tender_view(spark, sf_dir), e, TEST_METHOD, enquiry_hot=hot)


@register("score_model_table")
def q_score_model_table(spark, sf_dir):
    """SR-1 with a stored node table of 100 trees and 12,700 nodes, scored by bit masks of leaves."""
    path = shared_dir(spark, "model")
    model_table(spark, FEATURES).write.parquet(path)
    return _rounded(score(_features(spark, sf_dir), ensemble_from_table(spark.read.parquet(path))))


#: Fixed values of the linear stand-in model: weights in the order of the features, defaults for missing values.
LOGISTIC = dict(weights=(0.02, 0.3, -0.05, 0.1, 0.2, -0.4), intercept=0.5, defaults=(10.0, 0.0, 3.0, 0.0, 0.0, 2.0), threshold=0.35)


@register("score_logistic")
def q_score_logistic(spark, sf_dir):
    """SR-1b: a linear classifier with a threshold of its own, from pickle to ``predict``."""
    return _rounded(score_with_model(_features(spark, sf_dir), LogisticModel(**LOGISTIC)))


@register("prediction_changes")
def q_prediction_changes(spark, sf_dir):
    """JN-3: only what changed, a row per tender and column."""
    return changed_values(_rounded(scored_views(spark, sf_dir)), _rounded(scored_views(spark, sf_dir, compat_zero=True)))


@register("harvest_shapes")
def q_harvest_shapes(spark, sf_dir):
    """HV-3: fragments of 7 to 10 fields, without a link, with CR LF."""
    return parse_fragments(harvest_shapes_view(spark, sf_dir))


@register("result_table")
def q_result_table(spark, sf_dir):
    """SK-1: results written by year, the last year run again with other values, the table read back."""
    path = shared_dir(spark, "result-table")
    rows = tender_view(spark, sf_dir).select("ocid", F.year("start_ts").cast("bigint").alias("Year"),
                                             (F.col("contract_value") - F.col("award_value")).alias("nf059"))
    write_partitions(rows, path, ["Year"])
    last = rows.agg(F.max("Year")).first()[0]
    if last is not None:
        again = spark.read.parquet(path).where(F.col("Year") == last).select("ocid", F.col("Year").cast("bigint"), (F.col("nf059") * 2).alias("nf059"))
        again.write.parquet(once := shared_dir(spark, "result-again"))  # a table that is read can't be replaced
        write_partitions(spark.read.parquet(once), path, ["Year"])
    return spark.read.schema(rows.schema).parquet(path)


def _counted(df: DataFrame, arrays: list[str]) -> DataFrame:
    """JSON arrays as their length: the order of questions and bids within a release is free."""
    return df.select(*[F.json_array_length(f"`{c}`").cast("bigint").alias(c) if c in arrays else F.col(f"`{c}`") for c in df.columns])


@register("csv_export")
def q_csv_export(spark, sf_dir):
    """SK-2: all 38 columns exported as CSV (with gzip) and read back; arrays as their length."""
    p = indicator_projection(packages_of(spark, sf_dir))
    path = shared_dir(spark, "csv-export")
    export_csv(p, path, escape='"', **GZIP)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    typed = back.select(*[F.col(f"`{c}`").cast("double" if c in _DOUBLES else "bigint" if c in _LONGS else "string").alias(c) for c in back.columns])
    return _counted(typed, [f.name for f in p.schema.fields if isinstance(f.dataType, ArrayType)])


@register("drop_null_columns")
def q_drop_null_columns(spark, sf_dir):
    """PR-7 / AG-8: all 38 columns stored, and those that are null everywhere left out by the files' footers."""
    path = shared_dir(spark, "projection")
    p = indicator_projection(packages_of(spark, sf_dir))
    p.write.parquet(path)
    out = drop_null_columns(spark, path)
    return _counted(csv_ready(out), [f.name for f in out.schema.fields if isinstance(f.dataType, (ArrayType, VariantType))])


@register("flatten_variant")
def q_flatten_variant(spark, sf_dir):
    """PR-3: first releases flattened with the schema that the documents have; arrays as their length."""
    docs = spark.read.text(landed(spark, sf_dir, "lines")).select(F.parse_json("value").alias("d"))
    flat = flatten_variant(docs.select(F.variant_get("d", "$.releases[0]", "variant").alias("r")), "r", sep="__")
    return _counted(flat, ["tag", "awards", "contracts", "auctions", "tender__enquiries"])
