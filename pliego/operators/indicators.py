"""Indicator pipeline steps (PL-2, PL-3; DT-1 … DT-6, NM-1, NM-2).

Works on one row per tender whose period columns are timestamps (or ISO
text — ``instant`` parses text and passes timestamps through).  Column names
are those of the indicator pipeline's output.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import (floor_days, hours_between, local_year, minutes_between,
                               timestamp_of)

# Source columns of the flat tender row used below (fixture names).
PERIOD_COLUMNS = {
    "tender_start": "start_ts",      # tenderPeriod.startDate
    "enquiry_start": "enq_start",    # enquiryPeriod.startDate
    "enquiry_end": "enq_end",        # enquiryPeriod.endDate
    "award_start": "award_start",    # awardPeriod.startDate
    "award_end": "award_end",        # awardPeriod.endDate
    "auction_start": "auction_start",  # auctions[0].period.startDate
    "auction_end": "close_ts",       # auctions[0].period.endDate
    "award_date": "award_end",       # awards[0].date
    "signed": "signed_ts",           # contracts[0].dateSigned
}


def durations(df: DataFrame, cols: dict[str, str] = PERIOD_COLUMNS) -> DataFrame:
    """DT-1a … DT-5: Year and the period lengths of the indicator pipeline."""
    c = {k: timestamp_of(df, v) for k, v in cols.items()}
    return df.select(
        "*",
        local_year(cols["tender_start"]).alias("Year"),
        floor_days(c["award_end"], c["tender_start"]).alias("Dif_Day_Recep_Ofer"),
        floor_days(c["enquiry_end"], c["enquiry_start"]).alias("enqui_perio"),
        minutes_between(c["auction_end"], c["auction_start"]).alias("audi_perio"),
        floor_days(c["award_end"], c["award_start"]).alias("awar_perio"),
    )


def sign_hours(df: DataFrame, signed: str = "signed_ts", award_date: str = "award_end") -> DataFrame:
    """DT-6 ``nf061``: hours from award to contract signature."""
    return df.withColumn("nf061", hours_between(timestamp_of(df, signed),
                                                timestamp_of(df, award_date)))


def value_gap(df: DataFrame, contract: str = "contract_value", award: str = "award_value") -> DataFrame:
    """NM-1 ``nf059``: contract value minus award value."""
    return df.withColumn("nf059", F.col(contract) - F.col(award))


def derived(tenders_with_stats: DataFrame) -> DataFrame:
    """PL-2: durations plus the indicator pipeline's question measures.

    Expects the columns of ``enquiries.with_enquiry_stats``.
    """
    d = durations(tenders_with_stats)
    return d.withColumnsRenamed({
        "n_questions": "Number_ques", "num_pregu": "Num_Pregu", "num_respu": "Num_Respu",
        "qa_gap": "Pre_No_Respu", "mean_response_days": "Mean_Days_Respon"})


def red_flags(derived_df: DataFrame) -> DataFrame:
    """PL-3: nf061, nf059, NF039 (unanswered, narrow), NF018, Nf030.

    Expects ``unanswered_narrow`` and the bid columns ``NF018`` / ``Nf030``.
    """
    d = derived_df
    return d.select(
        *[F.col(c).alias("NF039") if c == "unanswered_narrow" else F.col(c) for c in d.columns],
        hours_between(timestamp_of(d, "signed_ts"), timestamp_of(d, "award_end")).alias("nf061"),
        (F.col("contract_value") - F.col("award_value")).alias("nf059"))


RED_FLAG_OUTPUT = [
    "ocid", "tender_key", "in_ent", "Year", "Dif_Day_Recep_Ofer", "enqui_perio",
    "audi_perio", "awar_perio", "Number_ques", "Num_Pregu", "Num_Respu",
    "Pre_No_Respu", "Mean_Days_Respon", "nf061", "nf059", "NF039", "NF018", "Nf030",
]
