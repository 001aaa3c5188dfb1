"""Sharding by extendible hashing, in DataFrame operations only.

A row's hash is a string of bits, 128 of its key and 128 of the whole row.  The
directory maps hash prefixes to shards: it starts with one shard, and each round
splits only the shards over the byte limit, on one more bit, until all fit.

Rounds work on cells (the summed sizes of all rows with the same first bits),
not on rows.  Where a cell alone is over the limit, a further pass breaks up
that cell's rows, and only those, into finer cells; bits on which none of the
open shards can part are skipped.  Rows that agree in all bits are equal rows:
their shard becomes a chain of parts with as many rows each as fit.  A single
row over the limit is a shard of its own.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_unique, without, written

KEY_BITS, ALL_BITS = 128, 256
#: Bits by which a pass's cells are finer than the shards it is to form.
FINER = 6
NEW = ("shard", "depth", "part", "shard_rows", "shard_bytes")


def hex_bits(digest: Column) -> Column:
    """The 128 bits of an MD5 digest in hex."""
    halves = [F.lpad(F.conv(F.substring(digest, at, 16), 16, 2), 64, "0") for at in (1, 17)]
    return F.concat(*halves)


def prefix(bits: int) -> Column:
    """The first bits of a row's hash; the row's own part is computed only where the key's is used up."""
    if bits <= KEY_BITS:
        return F.left(F.col("_key"), F.lit(bits))
    return F.concat(F.col("_key"), F.left(F.col("_row"), F.lit(bits - KEY_BITS)))


def hashed(df: DataFrame, key: str, size: Column) -> DataFrame:
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select("*", size.cast("long").alias("_bytes"),
                     hex_bits(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\0")))).alias("_key"),
                     hex_bits(F.md5(whole)).alias("_row"))


def common_bits(a: str, b: str) -> Column:
    return F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda n: F.left(F.col(a), n) == F.left(F.col(b), n)))


def directories(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Per pass its depth and a directory (cell, shard, parts, shard_rows, shard_bytes, rows).

    A cell whose shard is null is looked up in the next pass, by more bits.
    """
    out = []
    at, depth, open_ = 0, 0, None
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    while True:
        depth = min(ALL_BITS, max(depth, at + max(0, (total // limit).bit_length())) + FINER)
        part = rows if open_ is None else rows.withColumn("_at", prefix(at)).join(open_.select(F.col("shard").alias("_at")), "_at", "left_semi")
        bits = prefix(KEY_BITS if depth <= KEY_BITS else ALL_BITS)
        cells = written(part.groupBy(prefix(depth).alias("cell"))
                        .agg(F.sum("_bytes").alias("bytes"), F.count("*").alias("rows"), F.min(bits).alias("lo"), F.max(bits).alias("hi")), "cells")
        levels = []
        level = at
        while True:
            own = cells if open_ is None else cells.join(
                open_.select(F.col("shard").alias("over")), F.left("cell", F.lit(last)) == F.col("over"), "left_semi")
            shards = written(own.groupBy(F.left("cell", F.lit(level)).alias("shard"))
                             .agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"),
                                  F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                             .withColumn("same", common_bits("lo", "hi")).drop("lo", "hi"), "shards")
            fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
            levels.append((level, shards.filter(fits).withColumn("parts", F.lit(1).cast("long"))))
            open_, last = shards.filter(~fits), level
            least = open_.agg(F.min("same")).first()[0]
            if least is None or level == depth:
                break
            level = min(depth, max(level + 1, least))
        if least is not None and depth == ALL_BITS:  # equal rows
            fit = F.greatest(F.lit(1), F.floor(F.lit(limit) * F.col("shard_rows") / F.col("shard_bytes")))
            levels.append((level, open_.withColumn("parts", F.ceil(F.col("shard_rows") / fit).cast("long"))))
            least = None
        named = reduce(DataFrame.unionByName, [d.select("shard", "parts", "shard_rows", "shard_bytes") for _, d in levels])
        depths = sorted({n for n, _ in levels})
        looked = cells.select("cell", "rows", F.explode(F.array(*[F.left("cell", F.lit(n)) for n in depths])).alias("shard"))
        hit = looked.join(named, "shard").drop("rows")
        out.append((depth, written(cells.select("cell", "rows").join(hit, "cell", "left"), "directory")))
        if least is None:
            return out
        at, depth = depth, max(depth, least)  # bits that each open shard has in common need no cells


def extendible_shards(df: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """``df`` with shard (the prefix bits), depth, part, shard_rows and shard_bytes.

    Each (shard, part) has at most ``limit`` bytes or is a single row.  part is
    0 but for chains of equal rows; shard_rows and shard_bytes are the whole
    chain's.  Null keys hash as one key; a null size counts 0; an empty table
    has no shards.  Input columns with a new one's name are replaced.
    """
    base = without(df, *NEW)
    rows = hashed(base, key, F.coalesce(size, F.lit(0)))
    passes = directories(rows, limit)
    total = rows.count()
    done, left = [], rows
    for n, (depth, found) in enumerate(passes):
        looked = join_unique(left.withColumn("cell", prefix(depth)), found, "cell", "rows", total)
        done.append(looked.filter(F.col("shard").isNotNull()).drop("cell"))
        left = looked.filter(F.col("shard").isNull()).drop(*found.columns)
    placed = reduce(DataFrame.unionByName, done).drop("_key", "_row")
    single = placed.filter("parts = 1").withColumn("part", F.lit(0).cast("long"))
    out = single.drop("parts", "_bytes")
    if not passes[-1][1].filter("parts > 1").isEmpty():
        out = out.unionByName(chained(placed.filter("parts > 1"), base.columns))
    return out.select(*[F.col(f"`{c}`") for c in base.columns], "shard", F.length("shard").alias("depth"), "part", "shard_rows", "shard_bytes")


def chained(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Equal rows numbered and dealt to the parts of their chain.

    They are counted per input partition, the counts are put in a row, and the
    rows are made again from the counts, so no task holds all copies.
    """
    keys = [F.col(f"`{c}`") for c in columns] + [F.col(c) for c in ("shard", "parts", "shard_rows", "shard_bytes")]
    counts = written(rows.groupBy(*keys, F.spark_partition_id().alias("_pid")).agg(F.count("*").alias("_n")), "copies")
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_pid", *keys).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("_first", F.coalesce(before, F.lit(0))).repartition("shard", "_pid")
    number = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("_i")
    per_part = F.ceil(F.col("shard_rows") / F.col("parts"))
    return (starts.select(*keys, number).withColumn("part", F.floor(F.col("_i") / per_part).cast("long")).drop("_i", "parts"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard and part, each written by one task."""
    sharded.repartition("shard", "part").write.option("compression", "zstd").partitionBy("shard", "part").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows written by ``write_shards``; the folder of the shard without a bit has no name."""
    return spark.read.schema(schema).parquet(path).withColumn("shard", F.coalesce("shard", F.lit(""))).select(*schema.names)
