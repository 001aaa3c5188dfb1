"""Readers for the parquet tables of a test-data directory."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Resolving a parquet source lists files and reads the schema on the driver;
# a DataFrame is an immutable lazy plan, so one per (session, path) is reused.
_READS: dict[tuple[int, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as a lazy parquet scan (filters and projections push down)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), path)
    df = _READS.get(key)
    if df is None or df.sparkSession is not spark:
        df = _READS[key] = spark.read.parquet(path)
    return df
