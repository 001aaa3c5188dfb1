"""Both pipelines over OCDS release packages (nested form, no shuffle).

* ``indicators_from_packages`` — the indicator flow: one row per package
  line, fields of its first release, method filter, derived variables and
  red flags.  Every measure is a higher-order function over the release's
  own arrays, so the plan is scan → filter → project.
* ``features_from_packages`` — the scoring flow: one row per release, the
  six model features; ``score`` then adds the prediction.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nested import (array_len, count_present, count_truthy, late_bids, late_questions,
                                mean_response_days, typed_enquiries, unanswered_narrow,
                                unanswered_wide, variant_items)
from ..functions.text import process_code
from ..functions.times import floor_days, instant, local_year
from ..operators.indicators import durations, sign_hours, value_gap
from ..sources.landing import FIRST_METHOD
from ..sources.ocds import indicator_projection, releases

# Period columns of the indicator projection (see ``indicators.durations``).
PACKAGE_PERIODS = {
    "tender_start": "TTPSDate", "enquiry_start": "TEPSDate", "enquiry_end": "TEPEDate",
    "award_start": "TAPSDate", "award_end": "TAPEDate", "auction_start": "bid_st_Date",
    "auction_end": "bid_en_Date", "award_date": "awardsDate", "signed": "dateSigned",
}

INDICATOR_OUTPUT = [
    "ocid", "in_ent", "Year", "Dif_Day_Recep_Ofer", "enqui_perio", "audi_perio", "awar_perio",
    "Number_ques", "Num_Pregu", "Num_Respu", "Pre_No_Respu", "Mean_Days_Respon",
    "nf061", "nf059", "NF039", "NF018", "Nf030",
]


def indicators_from_packages(packages: DataFrame, method: str | None = None) -> DataFrame:
    """PL-4 on packages: projection → method filter → derived → red flags."""
    if method is not None and FIRST_METHOD in packages.columns:
        # parquet landing: the same test on the partition column prunes files
        packages = packages.where(F.col(FIRST_METHOD) == F.lit(method))
    # ``year`` (date cast) and ``Year`` (local year) differ only in case in the
    # source; Spark resolves names case-insensitively, so the first is renamed.
    p = indicator_projection(packages).withColumnRenamed("year", "year_cast")
    if method is not None:
        p = p.where(F.col("PMethoDetails") == F.lit(method))
    d = durations(p, PACKAGE_PERIODS)
    d = d.select(
        "*",
        count_present("enquiries").alias("Number_ques"),
        count_truthy("enq_desc").alias("Num_Pregu"),
        count_truthy("enq_ans").alias("Num_Respu"),
        (count_truthy("enq_desc") - count_truthy("enq_ans")).alias("Pre_No_Respu"),
        mean_response_days("enquiries").alias("Mean_Days_Respon"),
    )
    d = value_gap(sign_hours(d, "dateSigned", "awardsDate"), "ContractValue", "awardsvalue")
    return d.select(
        "*",
        unanswered_narrow("enquiries", "in_ent").alias("NF039"),
        array_len("bids").cast("bigint").alias("NF018"),
        late_bids("bids", "bid_en_Date").alias("Nf030"),
    )


def features_from_packages(packages: DataFrame, method: str | None = None,
                           compat_zero: bool = False, partitions: int | None = None) -> DataFrame:
    """PL-1 on packages: one row per release, the six features (DOUBLE).

    ``partitions`` spreads the releases after the explode — use it for
    whole-document packages, where each file is read by a single task.
    """
    r = releases(packages, partitions)
    t = F.col("tender")
    if method is not None:
        r = r.where(t["procurementMethodDetails"] == F.lit(method))
    enq = t["enquiries"]
    return r.select(
        "ocid",
        floor_days(instant(t["awardPeriod"]["endDate"]), instant(t["awardPeriod"]["startDate"]))
          .cast("double").alias("awar_perio"),
        unanswered_wide(enq).cast("double").alias("Pre_No_Respu"),
        floor_days(instant(t["enquiryPeriod"]["endDate"]), instant(t["enquiryPeriod"]["startDate"]))
          .cast("double").alias("enqui_perio"),
        array_len(variant_items(enq)).cast("double").alias("Number_ques"),
        late_questions(typed_enquiries(enq), instant(t["enquiryPeriod"]["endDate"]), compat_zero)
          .cast("double").alias("NF039"),
        t["numberOfTenderers"].cast("double").alias("n_of_Tend"),
        local_year(t["tenderPeriod"]["startDate"]).alias("Year"),
        process_code(F.col("ocid")).alias("Codigo"),
    )
