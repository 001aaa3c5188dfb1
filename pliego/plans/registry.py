"""Registered queries: name → ``fn(spark, sf_dir) -> DataFrame``.

Every query reads whole test tables (through the fixture views) so its work
grows with the data; none collects.  The DuckDB twin of each checked query
is ``oracle.SQL[name]``.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import astuple, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nested import variant_items
from ..functions.text import RE_NARROW, RE_WIDE, match_count, matches, process_code, strip_tags, url_tail
from ..functions.times import (date_year, floor_days, hours_between, iso_with_offset, local_year,
                               minutes_between)
from ..operators.bids import bid_count, bid_flat, bid_stats
from ..operators.enquiries import enquiry_stats, own_stats
from ..operators.harvest import (first_window_match, found_codes, harvest_join, harvested_codes, parse_fragments,
                                 tender_codes)
from ..operators.indicators import RED_FLAG_OUTPUT
from ..operators.reshape import drop_all_null, flatten_struct, parse_dates
from ..operators.scoring import (DEFAULT_ENSEMBLE, FEATURES, TreeEnsembleModel, display_table, ensemble_from_table,
                                 highlight_flags, prediction_diff, score, score_with_model, tender_card)
from ..sources.sinks import csv_ready
from ..sources.fragments import read_fragment_table
from ..sources.landing import landed
from ..sources.ocds import (first_release, indicator_projection, read_package_lines, read_package_parquet,
                            read_packages, read_zipped_packages, releases, sql_projection)
from ..sources.release_stream import read_release_stream
from ..sources.tables import table
from .packages import INDICATOR_OUTPUT, features_from_packages, indicators_from_packages
from .flows import (indicator_flow, indicator_flow_views, lookup, scored_views, scored_with_status,
                    scoring_features)
from .views import TEST_METHOD, bids_view, enquiry_view, enquiry_view_and_hot, harvest_view, tender_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# --- composed flows -----------------------------------------------------------

@register("red_flags_full")
def q_red_flags_full(spark, sf_dir):
    """PL-4: method filter → derived variables → red flags (flagship)."""
    return indicator_flow_views(spark, sf_dir, TEST_METHOD)


@register("red_flags")
def q_red_flags(spark, sf_dir):
    """PL-3: red flags for every tender."""
    return indicator_flow_views(spark, sf_dir, None).select(
        "ocid", "tender_key", "nf061", "nf059", "NF039", "NF018", "Nf030")


@register("derived")
def q_derived(spark, sf_dir):
    """PL-2: durations and question measures of kept tenders."""
    return indicator_flow_views(spark, sf_dir, TEST_METHOD).select(
        "ocid", "tender_key", "Year", "Dif_Day_Recep_Ofer", "enqui_perio", "audi_perio",
        "awar_perio", "Number_ques", "Num_Pregu", "Num_Respu", "Pre_No_Respu",
        "Mean_Days_Respon")


# --- filters -------------------------------------------------------------------

@register("filter_method")
def q_filter_method(spark, sf_dir):
    """FL-1: keep one procurement method (exact match; NULL dropped)."""
    t = tender_view(spark, sf_dir)
    return t.where(F.col("method") == F.lit(TEST_METHOD)).select("tender_key", "ocid", "method")


# --- scalar derivations ----------------------------------------------------------

@register("floor_days")
def q_floor_days(spark, sf_dir):
    """DT-2, DT-3, DT-4: floored whole-day periods."""
    t = tender_view(spark, sf_dir)
    return t.select("tender_key",
                    floor_days("enq_end", "enq_start").alias("enqui_perio"),
                    floor_days("award_end", "award_start").alias("awar_perio"),
                    floor_days("award_end", "start_ts").alias("Dif_Day_Recep_Ofer"))


@register("auction_minutes")
def q_auction_minutes(spark, sf_dir):
    """DT-5: auction period in minutes."""
    t = tender_view(spark, sf_dir)
    return t.select("tender_key", minutes_between("close_ts", "auction_start").alias("audi_perio"))


@register("sign_hours")
def q_sign_hours(spark, sf_dir):
    """DT-6: nf061, award → signature in hours."""
    t = tender_view(spark, sf_dir)
    return t.select("tender_key", hours_between("signed_ts", "award_end").alias("nf061"))


@register("value_gap")
def q_value_gap(spark, sf_dir):
    """NM-1: nf059, contract value − award value."""
    t = tender_view(spark, sf_dir)
    return t.select("tender_key", (F.col("contract_value") - F.col("award_value")).alias("nf059"))


@register("tender_year")
def q_tender_year(spark, sf_dir):
    """DT-1a / DT-1b on ISO text with a UTC offset (local year, date cast)."""
    t = tender_view(spark, sf_dir).select(
        "tender_key", iso_with_offset("start_ts").alias("start_txt"),
        iso_with_offset("enq_end").alias("enq_end_txt"))
    return t.select("tender_key", local_year("start_txt").alias("Year"),
                    date_year("start_txt").alias("year_cast"),
                    local_year("enq_end_txt").alias("enq_end_year"))


# --- per-tender aggregates (flat form) -------------------------------------------

def _enq_stats(spark, sf_dir):
    e, hot = enquiry_view_and_hot(spark, sf_dir)
    return enquiry_stats(e, tender_view(spark, sf_dir), hot=hot)


@register("bid_count")
def q_bid_count(spark, sf_dir):
    """AG-1 on bids: NF018 per tender with bids."""
    return bid_count(bids_view(spark, sf_dir))


@register("late_bids")
def q_late_bids(spark, sf_dir):
    """AG-6: NF018 and Nf030 for every tender (NULL without bids)."""
    t = tender_view(spark, sf_dir)
    s = bid_stats(bids_view(spark, sf_dir), t)
    return t.select("tender_key").join(s, "tender_key", "left")


@register("array_len")
def q_array_len(spark, sf_dir):
    """AG-1 on questions: Number_ques (scoring pipeline) per tender with questions."""
    return own_stats(enquiry_view(spark, sf_dir)).select("tender_key", F.col("n_questions").alias("Number_ques"))


@register("qa_gap")
def q_qa_gap(spark, sf_dir):
    """AG-2: question / answer counts of the indicator pipeline."""
    return own_stats(enquiry_view(spark, sf_dir)).select(
        "tender_key", F.col("n_questions").alias("Number_ques"),
        F.col("num_pregu").alias("Num_Pregu"), F.col("num_respu").alias("Num_Respu"),
        F.col("qa_gap").alias("Pre_No_Respu"))


@register("unanswered_wide")
def q_unanswered_wide(spark, sf_dir):
    """AG-3: Pre_No_Respu of the scoring pipeline."""
    return own_stats(enquiry_view(spark, sf_dir)).select(
        "tender_key", F.col("unanswered_wide").alias("Pre_No_Respu"))


@register("mean_response_days")
def q_mean_response_days(spark, sf_dir):
    """AG-4: null-poisoned mean days to answer."""
    return own_stats(enquiry_view(spark, sf_dir)).select(
        "tender_key", F.col("mean_response_days").alias("Mean_Days_Respon"))


@register("late_questions")
def q_late_questions(spark, sf_dir):
    """AG-5a: NF039 of the scoring pipeline (late questions)."""
    return _enq_stats(spark, sf_dir).select("tender_key", F.col("late_questions").alias("NF039"))


@register("unanswered_narrow")
def q_unanswered_narrow(spark, sf_dir):
    """AG-5b: NF039 of the indicator pipeline (unanswered, narrow)."""
    return _enq_stats(spark, sf_dir).select("tender_key", F.col("unanswered_narrow").alias("NF039"))


# --- text rules ------------------------------------------------------------------

# Fixed value: a topic that the test documents do hold (the procurement patterns never occur in them).
TEST_TOPIC = "[Ll]icen[cs]e|[Cc]opyright|LICENSE "


@register("topic_wide")
def q_topic_wide(spark, sf_dir):
    """FL-3a: wide convalidation pattern per question (hit and match count)."""
    e = enquiry_view(spark, sf_dir)
    return e.select("tender_key", "enq_no", matches("description", RE_WIDE).alias("wide_hit"),
                    match_count("description", RE_WIDE).alias("wide_count"))


@register("topic_narrow")
def q_topic_narrow(spark, sf_dir):
    """FL-3b: narrow pattern per question (kept = no hit)."""
    e = enquiry_view(spark, sf_dir)
    return e.select("tender_key", "enq_no", matches("description", RE_NARROW).alias("narrow_hit"))


@register("topic_documents")
def q_topic_documents(spark, sf_dir):
    """FL-3a / FL-3b over whole document texts (volume run)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", match_count("text", RE_WIDE).alias("wide_count"),
                    matches("text", RE_NARROW).alias("narrow_hit"),
                    match_count("text", TEST_TOPIC).alias("topic_count"),
                    matches("text", TEST_TOPIC).alias("topic_hit"))


@register("process_code")
def q_process_code(spark, sf_dir):
    """ST-1: process code from every tender id."""
    t = tender_view(spark, sf_dir)
    return t.select("tender_key", "ocid", process_code("ocid").alias("codigo"))


@register("url_tail")
def q_url_tail(spark, sf_dir):
    """ST-2: id from a link (last path segment)."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", url_tail("url").alias("tail"))


@register("strip_tags")
def q_strip_tags(spark, sf_dir):
    """ST-3: page text without tags (whole pages)."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", strip_tags("html").alias("text"))


@register("harvest_link")
def q_harvest_link(spark, sf_dir):
    """ST-6: first link of each harvested fragment, with the base URL."""
    return parse_fragments(harvest_view(spark, sf_dir)).select("page_id", "link")


@register("harvest_parse")
def q_harvest_parse(spark, sf_dir):
    """HV-3 (+ ST-4, ST-5, ST-7, PR-11): fragment → eight named fields."""
    return parse_fragments(harvest_view(spark, sf_dir))


@register("harvest_scan")
def q_harvest_scan(spark, sf_dir):
    """SC-4: a table of fetched pages read as fragments and parsed like them (all shapes of real HTML)."""
    pages = read_fragment_table(spark, f"{sf_dir.rstrip('/')}/pages.parquet", "html", ["page_id"])
    return parse_fragments(pages)


def _codes(spark, sf_dir):
    return tender_codes(tender_view(spark, sf_dir))


@register("harvest_join")
def q_harvest_join(spark, sf_dir):
    """JN-1: tenders ⋈ harvested rows on the process code."""
    return harvest_join(_codes(spark, sf_dir), parse_fragments(harvest_view(spark, sf_dir)))


@register("window_first_match")
def q_window_first_match(spark, sf_dir):
    """HV-1: first half-year window with a hit, and its first row."""
    return first_window_match(_codes(spark, sf_dir), parse_fragments(harvest_view(spark, sf_dir)))


@register("harvest_found")
def q_harvest_found(spark, sf_dir):
    """HV-2: tenders whose code was found on the search page."""
    return found_codes(_codes(spark, sf_dir), harvested_codes(parse_fragments(harvest_view(spark, sf_dir))))


# --- scoring -----------------------------------------------------------------------


def _lookup_ids(spark, sf_dir, other_only: bool = False):
    """The smallest id of the kept method and of the other ones: what the lookup queries look up."""
    t = tender_view(spark, sf_dir)
    if other_only:
        t = t.where(F.col("method") != F.lit(TEST_METHOD))
    return t.groupBy((F.col("method") == F.lit(TEST_METHOD)).alias("kept")).agg(F.min("ocid").alias("ocid"))


@register("features")
def q_features(spark, sf_dir):
    """PL-1 / PR-9: model features in the model's order."""
    e, hot = enquiry_view_and_hot(spark, sf_dir)
    return scoring_features(tender_view(spark, sf_dir), e, TEST_METHOD, enquiry_hot=hot)


# Digits in which the checked queries give a probability; the operators give all of them.
PROBA_DECIMALS = 9


def _rounded(scored):
    return scored.withColumn("proba", F.round("proba", PROBA_DECIMALS)).select(*scored.columns)


@register("score_trees")
def q_score_trees(spark, sf_dir):
    """SR-1: tree ensemble compiled to one CASE expression."""
    return _rounded(scored_views(spark, sf_dir))


@register("score_table")
def q_score_table(spark, sf_dir):
    """SR-1 with the ensemble read from a node table, walked as an array."""
    nodes = spark.createDataFrame([astuple(n) for n in DEFAULT_ENSEMBLE], NODE_TABLE)
    e, hot = enquiry_view_and_hot(spark, sf_dir)
    f = scoring_features(tender_view(spark, sf_dir), e, TEST_METHOD, enquiry_hot=hot)
    read = ensemble_from_table(nodes)
    copies = [replace(n, tree=n.tree + 3 * k, leaf=None if n.leaf is None else n.leaf / COPIES)
              for k in range(COPIES) for n in read]
    return _rounded(score(f, copies))


#: Node table of ``score_table`` and how often it holds each tree (a leaf's value is shared out), so that it is walked.
NODE_TABLE = "tree int, node int, feature string, threshold double, yes int, no int, missing int, leaf double"
COPIES = 32


@register("score_udf")
def q_score_udf(spark, sf_dir):
    """SR-1b: the same model as a Python classifier object via mapInPandas."""
    e, hot = enquiry_view_and_hot(spark, sf_dir)
    f = scoring_features(tender_view(spark, sf_dir), e, TEST_METHOD, enquiry_hot=hot)
    return _rounded(score_with_model(f, TreeEnsembleModel()))


@register("tender_card")
def q_tender_card(spark, sf_dir):
    """SR-2: summary card columns for every scored tender."""
    return tender_card(_rounded(scored_views(spark, sf_dir)))


@register("score_status")
def q_score_status(spark, sf_dir):
    """SR-3: score plus harvested Estado and Link."""
    return _rounded(scored_with_status(spark, sf_dir))


@register("highlight_flags")
def q_highlight_flags(spark, sf_dir):
    """CD-3: flagged / single bidder / deserted."""
    return highlight_flags(scored_with_status(spark, sf_dir)).select(
        "ocid", "flagged", "single_bidder", "deserted")


@register("lookup_scored")
def q_lookup_scored(spark, sf_dir):
    """FL-2b: one id after the method filter and scoring (empty for other methods)."""
    return _rounded(scored_views(spark, sf_dir, ocid=_lookup_ids(spark, sf_dir)))


@register("lookup_any")
def q_lookup_any(spark, sf_dir):
    """FL-2a: one id before the method filter (any method is found)."""
    t = lookup(tender_view(spark, sf_dir), _lookup_ids(spark, sf_dir, other_only=True))
    e, hot = enquiry_view_and_hot(spark, sf_dir)
    wanted = t.select("tender_key")
    out = indicator_flow(t, e.join(wanted, "tender_key", "left_semi"),
                         bids_view(spark, sf_dir).join(wanted, "tender_key", "left_semi"), None, enquiry_hot=hot)
    return out.select(*RED_FLAG_OUTPUT)


@register("outlier_lookup")
def q_outlier_lookup(spark, sf_dir):
    """JN-2 + PR-12: predictions joined to (ocid, codigo, Year)."""
    preds = _rounded(scored_views(spark, sf_dir)).select("ocid", "predict", "proba")
    codes = tender_codes(tender_view(spark, sf_dir))
    return codes.join(preds, "ocid", "inner")


@register("prediction_diff")
def q_prediction_diff(spark, sf_dir):
    """JN-3: intended late-question count vs the source's always-0 count."""
    return prediction_diff(_rounded(scored_views(spark, sf_dir)), _rounded(scored_views(spark, sf_dir, compat_zero=True)))


# --- release packages (sources, projections, nested measures) --------------------


_READERS = {"lines": read_package_lines, "package": read_packages, "zip": read_zipped_packages,
            "parquet": read_package_parquet}


def packages_of(spark, sf_dir, layout: str = "lines"):
    """Release packages landed from ``sf_dir`` (landed once per process)."""
    return _READERS[layout](spark, landed(spark, sf_dir, layout))


def _tender_rows(r):
    t = F.col("tender")
    stage = F.get(F.get(F.col("auctions"), 0)["stages"], 0)
    return r.select(
        "ocid", t["procurementMethodDetails"].alias("PMethoDetails"),
        t["procuringEntity"]["id"].alias("in_ent"), t["tenderPeriod"]["startDate"].alias("TTPSDate"),
        F.array_size(stage["bids"]).cast("bigint").alias("NF018"),
        F.array_size(variant_items(t["enquiries"])).cast("bigint").alias("Number_ques"))


@register("scan_lines")
def q_scan_lines(spark, sf_dir):
    """SC-1: JSON-lines packages read with the declared schema."""
    return _tender_rows(releases(packages_of(spark, sf_dir, "lines")))


@register("scan_package")
def q_scan_package(spark, sf_dir):
    """SC-2: whole-document packages as a stream of releases, spread before they are parsed."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _tender_rows(read_release_stream(spark, landed(spark, sf_dir, "package"), "document", tasks))


@register("scan_zip")
def q_scan_zip(spark, sf_dir):
    """SC-3: zip archives, the first member's releases as a stream."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _tender_rows(read_release_stream(spark, landed(spark, sf_dir, "zip"), "zip", tasks))


@register("view_sql")
def q_view_sql(spark, sf_dir):
    """SC-5: the scan registered as a temp view and projected in SQL."""
    return sql_projection(spark, packages_of(spark, sf_dir))


@register("explode_releases")
def q_explode_releases(spark, sf_dir):
    """PR-1: one row per release."""
    r = releases(packages_of(spark, sf_dir))
    return r.select("ocid", F.col("tender.id").alias("tender_id"), F.get("tag", 0).alias("tag"),
                    F.col("tender.mainProcurementCategory").alias("category"))


@register("first_element")
def q_first_element(spark, sf_dir):
    """PR-2 / PR-8: first-release tender fields of each package line."""
    p = indicator_projection(packages_of(spark, sf_dir))
    return p.select("ocid", "date", "PreRefe", "in_ent", "id", "description", "Tvalue", "enti_name",
                    "PMethoDetails", "TTPSDate", "TTPEDate", "TEPSDate", "TEPEDate", "TAPSDate",
                    "TAPEDate", "n_of_Tend", "year")


@register("first_nested")
def q_first_nested(spark, sf_dir):
    """PR-5 / 5b / 5c: first award, contract and auction fields."""
    p = indicator_projection(packages_of(spark, sf_dir))
    return p.select("ocid", "awardsDate", "awardsvalue", "ACPSDate", "ACPEDate", "award_id",
                    "CCPSDate", "CCPEDate", "ContractValue", "dateSigned", "bid_st_Date",
                    "bid_en_Date", F.array_size("bids").cast("bigint").alias("NF018"))


@register("array_field")
def q_array_field(spark, sf_dir):
    """PR-4: a field across an array of structs (order-free rendering)."""
    p = indicator_projection(packages_of(spark, sf_dir))

    def joined(c):
        return F.nullif(F.array_join(F.array_sort(c), "|"), F.lit(""))
    return p.select("ocid", joined("enq_desc").alias("enq_desc"), joined("enq_ans").alias("enq_ans"),
                    joined("enq_fechas").alias("enq_fechas"), joined("category").alias("category"))


@register("flatten_struct")
def q_flatten_struct(spark, sf_dir):
    """PR-3: release struct flattened to path-named columns (scalar leaves)."""
    flat = flatten_struct(first_release(packages_of(spark, sf_dir)), sep="__")
    keep = [f.name for f in flat.schema.fields if f.dataType.typeName() in ("string", "double", "long")]
    return flat.select(*keep)


_DATE_COLS = ["date", "TTPSDate", "TTPEDate", "TEPSDate", "TEPEDate", "TAPSDate", "TAPEDate",
              "awardsDate", "ACPSDate", "ACPEDate", "CCPSDate", "CCPEDate", "dateSigned",
              "bid_st_Date", "bid_en_Date"]


@register("parse_dates")
def q_parse_dates(spark, sf_dir):
    """PR-6: every column whose name matches Date|date parsed to an instant."""
    p = indicator_projection(packages_of(spark, sf_dir))
    parsed = parse_dates(p.select("ocid", "enq_fechas", *_DATE_COLS))
    return parsed.select("ocid", *[F.unix_micros(c).alias(c) for c in _DATE_COLS])


@register("drop_all_null")
def q_drop_all_null(spark, sf_dir):
    """PR-7 / AG-8: of all scalar columns of the projection those that are NULL in every row are dropped (one count pass)."""
    p = indicator_projection(packages_of(spark, sf_dir))
    scalar = [f.name for f in p.schema.fields if f.dataType.typeName() in ("string", "double", "long")]
    return drop_all_null(p.select(*scalar))


@register("bid_flat")
def q_bid_flat(spark, sf_dir):
    """AG-7: one row per bid of the first auction stage, unpacked by name."""
    r = releases(packages_of(spark, sf_dir))
    stage = F.get(F.get(F.col("auctions"), 0)["stages"], 0)
    b = r.select("ocid", F.explode(stage["bids"]).alias("bid")).select("ocid", "bid.*")
    return bid_flat(b).select("ocid", F.col("id").alias("bid_id"), "tenderer_id", "tenderer_name",
                              "amount", F.col("date").alias("bid_date"))


@register("ocds_red_flags")
def q_ocds_red_flags(spark, sf_dir):
    """PL-4 on packages: indicator pipeline, nested form."""
    return indicators_from_packages(packages_of(spark, sf_dir), TEST_METHOD).select(*INDICATOR_OUTPUT)


@register("ocds_features")
def q_ocds_features(spark, sf_dir):
    """PL-1 on packages: scoring features, VARIANT-aware question counts."""
    f = features_from_packages(packages_of(spark, sf_dir), TEST_METHOD)
    return f.select("ocid", *FEATURES)


@register("ocds_score")
def q_ocds_score(spark, sf_dir):
    """SR-1 on packages."""
    return _rounded(score(features_from_packages(packages_of(spark, sf_dir), TEST_METHOD).select("ocid", *FEATURES)))


@register("outlier_flagged")
def q_outlier_flagged(spark, sf_dir):
    """FL-7 + JN-2: only flagged predictions joined to (ocid, codigo, Year)."""
    preds = _rounded(scored_views(spark, sf_dir)).where(F.col("predict") == 1).select("ocid", "predict", "proba")
    return tender_codes(tender_view(spark, sf_dir)).join(preds, "ocid", "inner")


@register("harvest_missing")
def q_harvest_missing(spark, sf_dir):
    """HV-2 complement: tenders whose code was not found."""
    return found_codes(_codes(spark, sf_dir), harvested_codes(parse_fragments(harvest_view(spark, sf_dir))),
                       how="left_anti")


@register("parquet_red_flags")
def q_parquet_red_flags(spark, sf_dir):
    """PL-4 on packages landed as parquet (parsed once, nested columns pruned)."""
    return indicators_from_packages(packages_of(spark, sf_dir, "parquet"), TEST_METHOD).select(
        *INDICATOR_OUTPUT)


@register("parquet_score")
def q_parquet_score(spark, sf_dir):
    """SR-1 on packages landed as parquet."""
    f = features_from_packages(packages_of(spark, sf_dir, "parquet"), TEST_METHOD)
    return _rounded(score(f.select("ocid", *FEATURES)))


@register("display_table")
def q_display_table(spark, sf_dir):
    """Display rules of the scored table (percent, whole numbers, clickable link)."""
    return display_table(_rounded(scored_with_status(spark, sf_dir)))


@register("csv_ready")
def q_csv_ready(spark, sf_dir):
    """SK-2: all 38 columns as they are exported, nested ones as JSON text.

    The order of bids and questions within a release is free: both are sorted,
    and the fields of the questions follow them.
    """
    p = indicator_projection(packages_of(spark, sf_dir, "parquet"))
    p = p.withColumns({c: F.array_sort(c) for c in ("bids", "enquiries")})
    fields = {"enq_desc": "description", "enq_fechas": "date", "enq_ans_fechas": "dateAnswered", "enq_ans": "answer"}
    return csv_ready(p.withColumns({c: F.col("enquiries")[f] for c, f in fields.items()}))
