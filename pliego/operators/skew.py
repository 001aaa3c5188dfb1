"""Skew-safe join of a fact table with a dimension that is unique per key.

Per-tender indicators compare every fact (a bid, a question) with an
attribute of its tender (close time, enquiry deadline, buying entity) and then
aggregate by the tender key.  A plain sort-merge join puts every fact of one
key into one task, and because the aggregate that follows needs the same
partitioning, AQE's skew-join split does not apply.  If one tender held a
third of all bids, one task would do a third of the job.

``join_unique_dim`` salts only the hot keys, each in proportion to its size:

1. a frequent-items sketch of the facts' key column finds the keys with more than
   ``hot_rows`` facts: every task keeps ``TRACKED`` counters, the sketches are merged,
   and one row comes out.  Nothing is shuffled and no count per key is made.
   Which keys are hot decides only how the join is spread, never its result, so
   the sketch's error does not matter; a key with less than 1 / ``TRACKED`` of the
   facts may go unnoticed, which is no hot key at any size.
2. the list holds ``MAX_HOT`` keys at most, so it is broadcast;
3. a fact of a hot key gets a salt ``0 … salts-1`` (``salts = ceil(n / hot_rows)``) from
   a hash of the row; every other fact gets salt 0.  The dimension row of a hot key is
   repeated once per salt value, every other dimension row once with salt 0;
4. the join runs on ``(key, salt)``: no task receives more than about
   ``hot_rows`` facts of any one key (a tender with 3·10^11 bids becomes
   3·10^5 tasks' worth of work, not 1).  A later ``groupBy(key)`` needs its
   own exchange, and Spark puts a partial aggregation before it, so each task
   sends one row per key.

``kept_keys`` is the filter that goes before all that: a bitmap of the keys that a
filtered dimension still has, made by Spark and applied where the facts are scanned.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Facts of one key that one task should handle at most; keys above it are hot.
HOT_ROWS = 1_000_000
# Counters of a sketch, and hot keys at most.
TRACKED = 100_000
MAX_HOT = 10_000
# Bits of a bitmap of keys (128 KB): it filters up to about a million kept keys and lets all pass far beyond,
# where Spark's own runtime filter of large scans takes over.  More bits cost a longer array in every task.
KEY_BITS = 1 << 20


def hot_keys(facts: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(key, _salts)`` for keys holding more than ``hot_rows`` facts, ``MAX_HOT`` rows at most."""
    found = facts.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {MAX_HOT}, {TRACKED})").alias("_top"))
    return (found.select(F.explode("_top").alias("_t"))
            .select(F.col("_t.item").alias(key), F.col("_t.count").alias("_n")).where(F.col("_n") > hot_rows)
            .select(key, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_salts")))


def kept_keys(facts: DataFrame, dims: DataFrame, key: str, bits: int = KEY_BITS) -> DataFrame:
    """The facts whose key a bitmap of ``dims``' keys holds: all that join, and few others.

    The bitmap is a scalar subquery: Spark makes it once, and every task tests
    it as it scans, before anything is counted or shuffled.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    every = dims.sparkSession.range(0, bits >> 6, 1, 1).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
    words = (dims.where(F.col(key).isNotNull()).select(F.shiftright(slot, 6).alias("w"), one.alias("b"))
             .unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b")))
    bitmap = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bitmap")).scalar()
    word = F.get(bitmap, F.shiftright(slot, 6).cast("int"))
    return facts.where(F.call_function("getbit", word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1)


def join_unique_dim(facts: DataFrame, dims: DataFrame, key: str,
                    hot_rows: int = HOT_ROWS, how: str = "inner",
                    hot: DataFrame | None = None) -> DataFrame:
    """``facts ⋈ dims`` on ``key`` (dims unique per key), hot keys salted.

    ``how`` is ``inner`` or ``left`` (facts kept when the key has no dim row).
    ``hot`` — ``(key, _salts)`` from ``hot_keys`` on another table whose
    count per key bounds this one's (a superset of the hot keys, or more
    salts than needed, is safe); its rows are bounded by ``MAX_HOT``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if hot is None:
        hot = hot_keys(facts, key, hot_rows)
    hot = F.broadcast(hot)
    hashable = [f.name for f in facts.schema.fields if "variant" not in f.dataType.simpleString()]
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in hashable])
    salts = F.col("_salts")
    salted_facts = facts.join(hot, key, "left").select(
        *[F.col(f"`{c}`") for c in facts.columns],
        F.when(salts.isNotNull(), F.pmod(row_hash, salts)).otherwise(F.lit(0))
         .cast("int").alias("_salt"))
    copies = F.when(salts.isNotNull(), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    salted_dims = dims.join(hot, key, "left").select(
        *[F.col(f"`{c}`") for c in dims.columns], F.explode(copies).alias("_salt"))
    return salted_facts.join(salted_dims, [key, "_salt"], how).drop("_salt")
