"""What Parquet footers say about a table, read by a Spark job over its files.

A footer holds, for every row group and leaf column, how many values are null.
``null_columns`` adds that up without reading a data page; only columns that
the footers leave open are scanned.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import filesystem, qualified

_LEAVES = "column string, leaf string, depth int, repeated boolean, rows long, nulls long, known boolean"


def _read_footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    for b in batches:
        rows = []
        for path in b.column(0).to_pylist():
            store, name = filesystem(path)
            with store.open_input_file(name) as f:
                parquet = pq.ParquetFile(f)
                meta, top = parquet.metadata, parquet.schema_arrow
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for k in range(meta.num_columns):
                        leaf, stats = meta.schema.column(k), group.column(k).statistics
                        known = stats is not None and stats.has_null_count
                        name = leaf.path.split(".")[0]
                        # levels below the column that may be null on their own
                        rows.append((name, leaf.path, leaf.max_definition_level - top.field(name).nullable, leaf.max_repetition_level > 0,
                                     group.num_rows, stats.null_count if known else 0, known))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()))], names=_LEAVES.replace(",", "").split()[::2])


def leaf_nulls(spark: SparkSession, path: str) -> DataFrame:
    """(column, leaf, depth, repeated, rows, nulls, known) of the Parquet files at ``path``, added up over row groups.

    ``depth`` is the number of optional levels below the column down to the leaf;
    ``known`` is false where a file has no null counts.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
             .load(qualified(spark, path)).select("path"))
    return (files.mapInArrow(_read_footers, _LEAVES).groupBy("column", "leaf", "depth", "repeated")
            .agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("known").alias("known")))


def null_columns(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(columns that are null in every row, columns that had to be scanned to know).

    A value in any leaf settles that a column is not null.  That all leaves are
    null settles the opposite for a plain column or a leaf that only the column itself
    makes optional; a struct or an array may hold nulls without being null, so those are
    scanned, all in one pass, as are columns of files without null counts.
    """
    table = spark.read.parquet(path)
    leaves: dict[str, list] = {}
    for r in leaf_nulls(spark, path).collect():  # one row per leaf of the schema
        leaves.setdefault(r["column"], []).append(r)
    empty, scan = [], []
    for name in table.columns:
        own = leaves.get(name)
        if own is None:
            (scan if leaves else empty).append(name)  # a partition column, or a table without row groups
        elif any(r.known and not r.repeated and r.nulls < r.rows for r in own):
            continue
        elif any(r.known and not r.repeated and r.depth == 0 and r.nulls == r.rows for r in own):
            empty.append(name)
        else:
            scan.append(name)
    if scan:
        counts = table.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(scan)]).first()
        empty += [c for k, c in enumerate(scan) if not counts[k]]
    return [c for c in table.columns if c in empty], scan


def drop_null_columns(spark: SparkSession, path: str) -> DataFrame:
    """PR-7 / AG-8 on a stored table: the table without the columns that are null in every row."""
    empty, _ = null_columns(spark, path)
    table = spark.read.parquet(path)
    return table.select(*[F.col(f"`{c}`") for c in table.columns if c not in empty])
