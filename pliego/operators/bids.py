"""Bid indicators in flat form (AG-1, AG-6, AG-7, FL-6).

For bids stored one row per bid.  The nested form for release documents,
where bids are an array inside each release, is ``functions.nested``; both
give the same numbers.

Null rules follow the source pipeline:

* ``NF018`` — number of bids; NULL when the tender has no bid list.
* ``Nf030`` — bids dated strictly after the auction close.  NULL when there
  are no bids or when any bid has no tenderer entry or no value entry (an
  entry without an amount counts); a NULL close time counts nothing (0).  A
  flat table says so in ``tenderer_missing`` and ``value_missing``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import HOT_ROWS, join_unique_dim


def bid_stats(bids: DataFrame, tenders: DataFrame, key: str = "tender_key",
              close_col: str = "close_ts", hot_rows: int = HOT_ROWS,
              hot: DataFrame | None = None) -> DataFrame:
    """One row per tender key that has bids: ``NF018``, ``Nf030``."""
    facts = bids.select(
        key, "bid_ts",
        (F.col("tenderer_missing") | F.col("value_missing")).alias("_bad"))
    dims = tenders.select(key, F.col(close_col).alias("_close"))
    j = join_unique_dim(facts, dims, key, hot_rows, hot=hot)
    return j.groupBy(key).agg(
        F.count(F.lit(1)).alias("NF018"),
        F.when(F.max("_bad"), F.lit(None))
         .otherwise(F.count_if(F.col("bid_ts") > F.col("_close"))).cast("bigint").alias("Nf030"),
    )


def bid_count(bids: DataFrame, key: str = "tender_key") -> DataFrame:
    """AG-1 for bids: number of bids per tender (no tender attribute needed)."""
    return bids.groupBy(key).agg(F.count(F.lit(1)).alias("NF018"))


def bid_flat(bids: DataFrame) -> DataFrame:
    """AG-7: first tenderer id / name and amount of each bid, by field name.

    Works on the nested bid struct of a release (``tenderers`` array,
    ``value`` struct) exploded to one row per bid.
    """
    return bids.select(
        "*",
        F.get(F.col("tenderers"), 0).getField("id").alias("tenderer_id"),
        F.get(F.col("tenderers"), 0).getField("name").alias("tenderer_name"),
        F.col("value").getField("amount").alias("amount"),
        (F.coalesce(F.size("tenderers"), F.lit(0)) <= 0).alias("tenderer_missing"),
        F.col("value").isNull().alias("value_missing"),
    )
