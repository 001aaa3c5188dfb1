"""Harvested HTML row fragments (SC-4): files of one fragment each, or a table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fragment_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(file, fragment)``: each text file is one fragment, line ends kept."""
    rows = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("fragment"))


def read_fragment_table(spark: SparkSession, path: str, column: str, keys: list[str], fmt: str = "parquet") -> DataFrame:
    """``(keys…, fragment)`` from a table whose ``column`` holds a fragment per row."""
    return spark.read.format(fmt).load(path).select(*keys, F.col(column).alias("fragment"))
