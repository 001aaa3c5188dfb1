"""Fixture views: procurement-shaped data derived from the test tables.

The test tables hold no procurement data, so these views give them that shape
(the same definitions are written as SQL in ``plans/oracle.py`` for the
DuckDB check).  They are plain projections and equi-joins, so every query
built on them scans whole tables and scales with them.

* ``tender_view``   one row per order   → one tender
* ``bids_view``     one row per lineitem → one bid (no unique key)
* ``enquiry_view``  one row per user turn → one question; the answer is the
  next turn when the assistant speaks.  "Next turn" is an equi-join on
  ``(conv_id, turn + 1)`` — turns are contiguous — so a very long
  conversation is hash-spread over partitions by turn, unlike a window.
* ``harvest_view``  one HTML row fragment per page, shaped like a search-page
  result row for the tender with the same key.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import HOT_ROWS, hot_keys, join_unique_dim
from ..sources.tables import table

# --- fixed values of the fixture mapping -------------------------------------
# Priority that stands in for the kept procurement method in the test data.
TEST_METHOD = "1-URGENT"
# Process-code stem used when building test ids: ocds-5wno2w-SIE-<key>-<year>-<cust>.
TEST_CODE_STEM = "SIE"
# -----------------------------------------------------------------------------


def _plus(ts: Column, unit: str, n: Column) -> Column:
    return F.timestamp_add(unit, n, ts)


def tender_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenders_of(table(spark, sf_dir, "orders"))


def tenders_of(orders: DataFrame, *more: str) -> DataFrame:
    """One tender per row of ``orders``, with the columns ``more`` as they are."""
    d, k, c = F.col("o_orderdate"), F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(
        k.alias("tender_key"),
        F.concat(F.lit(f"ocds-5wno2w-{TEST_CODE_STEM}-"), k, F.lit("-"), F.year(d),
                 F.lit("-"), c).alias("ocid"),
        F.col("o_orderpriority").alias("method"),
        F.concat(F.lit("E"), k % 10).alias("in_ent"),
        c.alias("buyer_key"),
        d.alias("start_ts"),
        _plus(d, "HOUR", k % 17).alias("enq_start"),
        _plus(_plus(d, "DAY", c % 20 - 5), "HOUR", k % 24).alias("enq_end"),
        _plus(d, "DAY", c % 30).alias("award_start"),
        _plus(d, "DAY", c % 45).alias("award_end"),
        _plus(d, "HOUR", k % 72).alias("auction_start"),
        _plus(d, "DAY", F.lit(365)).alias("close_ts"),
        F.when(F.col("o_orderstatus") != "P",
               _plus(_plus(d, "DAY", c % 45), "HOUR", k % 50 - 5)).alias("signed_ts"),
        F.col("o_totalprice").alias("contract_value"),
        (F.col("o_totalprice") - c % 100).alias("award_value"),
        F.when(F.col("o_orderstatus") != "O", c % 7).alias("n_tenderers"),
        *more,
    )


def bids_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("tender_key"),
        F.col("l_shipdate").alias("bid_ts"),
        F.col("l_suppkey").alias("tenderer_id"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_suppkey").isNull().alias("tenderer_missing"),
        F.col("l_extendedprice").isNull().alias("value_missing"),
        "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus",
    )


def enquiry_hot_keys(spark: SparkSession, sf_dir: str, key: str = "conv_id",
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hot tender keys for questions, counted on the base table: a
    conversation has at least as many turns as questions, so this is a
    superset of the keys hot in ``enquiry_view`` (safe, and one cheap scan)."""
    conv = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias(key))
    return hot_keys(conv, key, hot_rows)


def enquiry_view(spark: SparkSession, sf_dir: str, hot: DataFrame | None = None) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    q = conv.where(F.col("role") == "user").select("conv_id", "turn", "text")
    a = (conv.where(F.col("role") == "assistant")
         .select(F.col("conv_id").alias("a_conv"), (F.col("turn") - 1).alias("a_turn"),
                 F.col("text").alias("next_text")))
    qa = q.join(a, (q.conv_id == a.a_conv) & (q.turn == a.a_turn), "left")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("conv_id"), "o_orderdate")
    # a conversation may be huge: its tender's date is attached with the
    # hot-key salted join rather than a plain one
    qa = qa.withColumn("_answered", F.col("a_conv").isNotNull()).drop("a_conv", "a_turn")
    j = join_unique_dim(qa, o, "conv_id", hot=hot if hot is not None else enquiry_hot_keys(spark, sf_dir))
    cid, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    answered = F.col("_answered")
    asked_h = (turn * 37 + cid) % 400
    return j.select(
        cid.alias("tender_key"),
        turn.alias("enq_no"),
        F.when(turn % 3 == 0, F.concat(F.lit("E"), cid % 10))
         .otherwise(F.concat(F.lit("S"), turn)).alias("author_id"),
        F.when((cid + turn) % 5 == 0, F.concat(F.lit("CONVALIDACION "), text))
         .when((cid + turn) % 7 == 0, F.lit("CONVALIDA convalidar"))
         .when((cid + turn) % 11 == 0, F.concat(F.lit("convalidación, "), text))
         .otherwise(text).alias("description"),
        F.when(answered, F.col("next_text")).alias("answer"),
        _plus(F.col("o_orderdate"), "HOUR", asked_h).alias("asked_ts"),
        F.when(answered, _plus(F.col("o_orderdate"), "HOUR",
                               asked_h + (turn * 13 + cid) % 90 - 10)).alias("answered_ts"),
    )


def enquiry_view_and_hot(spark: SparkSession, sf_dir: str, hot_rows: int = HOT_ROWS):
    """``(enquiry_view, hot tender keys)``: one hot-key count serves both the
    view's own join and the per-tender join that follows."""
    hot = enquiry_hot_keys(spark, sf_dir, hot_rows=hot_rows)
    return enquiry_view(spark, sf_dir, hot), hot.withColumnRenamed("conv_id", "tender_key")


def harvest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id")
    o = table(spark, sf_dir, "orders")
    j = p.join(o, p.page_id == o.o_orderkey, "inner")
    nl = F.lit("\n")
    pid = F.col("page_id")
    fragment = F.concat(
        F.lit('<td>'), nl, F.lit('<a href="info.cpe?id='), pid, F.lit(',">'),
        F.lit(f"{TEST_CODE_STEM}-"), pid, F.lit(" -"), F.year("o_orderdate"), F.lit("</a>"), nl,
        F.lit("ENT "), F.col("o_custkey") % 10, nl,
        F.col("o_orderpriority"), nl,
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("Desierta")).otherwise(F.lit("Adjudicada")), nl,
        F.lit("P"), F.col("o_custkey") % 24, nl,
        F.floor("o_totalprice").cast("bigint"), nl,
        F.col("o_orderdate").cast("date").cast("string"), F.lit("&nbsp;"),
    )
    return j.select(pid, fragment.alias("fragment"))


def harvest_shapes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``harvest_view`` in the shapes that pages come in: 7 to 10 fields, without a link, with CR LF."""
    f, shape, nl = F.col("fragment"), F.col("page_id") % 5, F.lit("\n")
    return harvest_view(spark, sf_dir).select(
        "page_id",
        F.when(shape == 1, F.concat(f, nl, F.lit("extra 8"), nl, F.lit("extra&nbsp;9")))
        .when(shape == 2, F.concat(f, nl, F.lit("extra 8&nbsp;")))
        .when(shape == 3, F.regexp_replace(f, "\n[^\n]*$", "&nbsp;"))
        .when(shape == 4, F.replace(F.regexp_replace(f, "</?a[^>]*>", ""), nl, F.lit("\r\n")))
        .otherwise(f).alias("fragment"))


#: Trees and levels of ``model_table``.
MODEL_TREES, MODEL_DEPTH = 100, 6


def model_table(spark: SparkSession, features: list[str]) -> DataFrame:
    """A node table at a fitted model's size: full trees, every node's test and every leaf by a rule."""
    inner = (1 << MODEL_DEPTH) - 1
    t, n = F.col("tree"), F.col("node")
    ids = spark.range(MODEL_TREES * (2 * inner + 1)).select(
        F.expr(f"id div {2 * inner + 1}").cast("int").alias("tree"), (F.col("id") % (2 * inner + 1)).cast("int").alias("node"))
    yes = 2 * n + 1

    def at(c: Column) -> Column:
        return F.when(n < inner, c)
    return ids.select(
        "tree", "node", at(F.element_at(F.array(*map(F.lit, features)), (t * 7 + n * 3) % len(features) + 1)).alias("feature"),
        at(((t * 31 + n * 17) % 24 - 3.5).cast("double")).alias("threshold"), at(yes).alias("yes"), at(yes + 1).alias("no"),
        at(yes + (t + n) % 2).alias("missing"), F.when(n >= inner, ((t * 13 + n * 29) % 201 - 100) / 1000.0).cast("double").alias("leaf"))
