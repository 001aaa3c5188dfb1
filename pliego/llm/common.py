"""Helpers shared by the operators: written tables, hot-key joins, Arrow batches."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import local_folder


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a local master gets a temporary folder;
    on a cluster that would be private to one machine, so it is an error.
    """
    return (spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark)).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage
    is cut, later readers don't recompute it and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that a task never holds all texts of a batch as Python strings."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def add_columns(df: DataFrame, text_col: str, new: T.StructType,
                make: Callable[[], Callable[[list[str | None]], list[pa.Array]]]) -> DataFrame:
    """``df`` with columns computed from a batch's texts in an Arrow worker.

    ``make()`` runs once per task and returns the batch function.  Input
    columns with the name of a new one are replaced.
    """
    base = without(df, *new.names)
    if text_col.lower() in {n.lower() for n in new.names}:
        raise ValueError(f"{text_col} can't be both read and replaced")
    at = [c.lower() for c in base.columns].index(text_col.lower())
    schema = T.StructType(base.schema.fields + new.fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for b in slices(batches):
            cols = each(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=names)

    return base.mapInArrow(run, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def text_key(col: str = "text"):
    """64-bit key of a text; with the document id it tells repeated ids with different texts apart."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("\0")))


def join_unique(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Left join on a key that is unique in ``right`` but may hold a third of ``left``.

    ``right`` carries in column ``rows`` how many left rows its key has.  Keys
    with over ``total / 400`` rows (so never more than 400 of them) are
    broadcast and joined where the rows lie; the rest shuffle evenly.
    """
    hot_at = max(1000, total // 400)
    hot = right.filter(F.col(rows) > hot_at)
    cold = right.filter(F.col(rows) <= hot_at).drop(rows)
    hot_keys = F.broadcast(hot.select(F.col(key)))
    return (left.join(F.broadcast(hot.drop(rows)), key, "inner")
            .unionByName(left.join(hot_keys, key, "left_anti").join(cold, key, "left")))


#: Bits of a bitmap for each of its rows, and their bounds as powers of two (32 MB at most).
BITS_EACH = 16
BITS_LEAST, BITS_MOST = 20, 28


def bitmap_of(df: DataFrame, col: str, rows: int) -> bytes:
    """Bitmap of a column of hashes: at most 2 ** ``BITS_MOST`` bits whatever the table.

    It holds every hash; what else it holds by chance grows once the rows pass
    its bits, so it may only decide what work is left out, never a result.
    """
    bits = min(BITS_MOST, max(BITS_LEAST, (BITS_EACH * rows).bit_length()))
    slot = F.col(col).bitwiseAND(F.lit((1 << bits) - 1))
    words = df.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(`{col}` & 63 as int))")).alias("b"))
    got = words.toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.tobytes()


def held_in(bitmap: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) a bitmap (uint64 words) holds."""
    slot = x & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


#: Rows of one group in a ranking step.
RANKED = 100_000


def first_of_each(rows: DataFrame, group: str, key: str, order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, which must tell rows with equal ``key`` apart.

    Large groups are ranked in parts by a hash of ``key`` first, so that no task
    sorts a whole group.  ``rank`` names a column for the place.
    """
    parts = -(-rows.count() // max(RANKED, 2 * n))
    while parts > 1:
        rows = rows.withColumn("_part", F.pmod(F.xxhash64(key, F.lit(parts)), F.lit(parts)))
        w = Window.partitionBy(group, "_part").orderBy(*order)
        rows = rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank", "_part")
        parts = -(-parts * n // max(RANKED, 2 * n))
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_rank") <= n)
    return rows.withColumnRenamed("_rank", rank) if rank else rows.drop("_rank")
