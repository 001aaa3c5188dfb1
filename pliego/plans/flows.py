"""Composed flows over flat tender / bid / question tables.

``indicator_flow`` is the indicator flow end to end (method filter →
derived variables → red flags).  The filter runs first so the joins and
aggregates only touch kept tenders; Catalyst pushes it into the scan.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import floor_days, timestamp_of
from ..operators.bids import bid_stats
from ..operators.enquiries import with_enquiry_stats
from ..operators.harvest import harvest_join, parse_fragments, tender_codes
from ..operators.indicators import RED_FLAG_OUTPUT, derived, red_flags
from ..operators.scoring import score
from ..operators.skew import HOT_ROWS, kept_keys
from .views import TEST_METHOD, bids_view, enquiry_view_and_hot, harvest_view, tender_view


def indicator_flow(tenders: DataFrame, enquiries: DataFrame, bids: DataFrame,
                       method: str | None = None, key: str = "tender_key",
                       hot_rows: int = HOT_ROWS, enquiry_hot: DataFrame | None = None) -> DataFrame:
    """Filter on method (if given), then derived variables and red flags.

    With a method the facts are cut to the kept tenders where they are scanned.
    """
    t = tenders
    if method is not None:
        t = tenders.where(F.col("method") == F.lit(method))
        enquiries, bids = kept_keys(enquiries, t, key), kept_keys(bids, t, key)
    with_q = with_enquiry_stats(t, enquiries, key, hot_rows=hot_rows, hot=enquiry_hot)
    with_b = with_q.join(bid_stats(bids, t, key, hot_rows=hot_rows), key, "left")
    return red_flags(derived(with_b))


def indicator_flow_views(spark: SparkSession, sf_dir: str, method: str | None = TEST_METHOD,
                             hot_rows: int = HOT_ROWS) -> DataFrame:
    """The indicator pipeline over the fixture views of a test-data directory."""
    e, hot = enquiry_view_and_hot(spark, sf_dir, hot_rows)
    out = indicator_flow(tender_view(spark, sf_dir), e, bids_view(spark, sf_dir), method,
                             hot_rows=hot_rows, enquiry_hot=hot)
    return out.select(*RED_FLAG_OUTPUT)


def lookup(tenders: DataFrame, ocid: str | DataFrame) -> DataFrame:
    """The tenders with one id, or with the ids of a table ``(ocid)``."""
    if isinstance(ocid, str):
        return tenders.where(F.col("ocid") == F.lit(ocid))
    return tenders.join(ocid.select("ocid"), "ocid", "left_semi")


# --- scoring pipeline ------------------------------------------------------------


def scoring_features(tenders: DataFrame, enquiries: DataFrame, method: str | None = None,
                     ocid: str | DataFrame | None = None, compat_zero: bool = False,
                     key: str = "tender_key", enquiry_hot: DataFrame | None = None) -> DataFrame:
    """PL-1 / PR-9: the six model features (DOUBLE, nullable) per kept tender.

    Filters (method, then an optional id or table of ids) run before any join;
    for a lookup the questions are cut to the tenders found before they are
    joined and grouped.
    """
    t = tenders if method is None else tenders.where(F.col("method") == F.lit(method))
    if ocid is not None:
        t = lookup(t, ocid)
        enquiries = enquiries.join(t.select(key), key, "left_semi")
    elif method is not None:
        enquiries = kept_keys(enquiries, t, key)
    s = with_enquiry_stats(t, enquiries, key, compat_zero=compat_zero, hot=enquiry_hot)
    return s.select(
        "ocid",
        floor_days(timestamp_of(s, "award_end"), timestamp_of(s, "award_start"))
          .cast("double").alias("awar_perio"),
        F.col("unanswered_wide").cast("double").alias("Pre_No_Respu"),
        floor_days(timestamp_of(s, "enq_end"), timestamp_of(s, "enq_start"))
          .cast("double").alias("enqui_perio"),
        F.col("n_questions").cast("double").alias("Number_ques"),
        F.col("late_questions").cast("double").alias("NF039"),
        F.col("n_tenderers").cast("double").alias("n_of_Tend"),
    )


def scored_views(spark: SparkSession, sf_dir: str, method: str | None = TEST_METHOD,
                 ocid: str | DataFrame | None = None, compat_zero: bool = False) -> DataFrame:
    """SR-1 over the fixture views: features → tree-ensemble score."""
    e, hot = enquiry_view_and_hot(spark, sf_dir)
    f = scoring_features(tender_view(spark, sf_dir), e, method, ocid, compat_zero, enquiry_hot=hot)
    return score(f)


def scored_with_status(spark: SparkSession, sf_dir: str, method: str | None = TEST_METHOD) -> DataFrame:
    """SR-3: score of the tenders with harvested status, and the status (one row per tender).

    Features are made for the tenders whose code was harvested, each once; the
    status is joined once, at the end.
    """
    t = tender_view(spark, sf_dir)
    if method is not None:
        t = t.where(F.col("method") == F.lit(method))
    h = parse_fragments(harvest_view(spark, sf_dir)).select(
        "page_id", "codigo", "publish_date", F.col("estado_del_proceso").alias("Estado"), F.col("link").alias("Link"))
    with_status = harvest_join(tender_codes(t).select("ocid", "codigo"), h).select("ocid", "Estado", "Link")
    e, hot = enquiry_view_and_hot(spark, sf_dir)
    f = scoring_features(t.join(with_status.select("ocid"), "ocid", "left_semi"), e, enquiry_hot=hot)
    return score(f.join(with_status, "ocid", "inner"))
