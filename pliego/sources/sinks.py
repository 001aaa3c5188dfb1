"""Sinks (SK-1, SK-2).

Results are lazy DataFrames; these write them out.  Parquet keeps nested
types; CSV cannot, so nested and VARIANT columns are written as JSON text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """SK-1: parquet, optionally partitioned (e.g. by ``Year``) for pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """SK-1: replaces the partitions that ``df`` has rows of and leaves the others, so that a month can be run again."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested / VARIANT columns as JSON text, everything else unchanged."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, VariantType):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite", escape: str = "\\", **options) -> None:
    """SK-2: CSV with a header row.  ``escape='"'`` doubles quotes, as spreadsheets do; ``options`` such as ``compression`` are the writer's."""
    csv_ready(df).write.mode(mode).option("header", True).option("escape", escape).options(**options).csv(path)
