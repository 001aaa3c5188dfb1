"""Question/answer indicators in flat form (AG-1 … AG-5b, FL-3 … FL-5).

For enquiries stored one row per question with columns ``description``,
``answer``, ``author_id``, ``asked_ts``, ``answered_ts``.  The nested form for
release documents is ``functions.nested``.

Two pipelines use the same names for different measures, so every output
here has its own name; the pipelines rename at the end:

=====================  =============================================  ==========
column                 meaning                                        pipeline
=====================  =============================================  ==========
``n_questions``        questions in the list                          both
``num_pregu``          questions with non-empty text                  indicators
``num_respu``          questions with a non-empty answer              indicators
``qa_gap``             ``num_pregu − num_respu`` (may be negative)    indicators
``unanswered_wide``    unanswered, wide pattern excluded; NULL if     scoring
                       any description is NULL
``mean_response_days`` mean floor-days asked → answered; NULL if any  indicators
                       question is unanswered
``late_questions``     asked after the enquiry deadline (or dates     scoring
                       unknown), not exactly one wide-pattern match
``unanswered_narrow``  unanswered after dropping NULL descriptions,   indicators
                       the entity's own questions and the narrow
                       pattern; NULL if the entity or an author id
                       is unknown
=====================  =============================================  ==========

Everything is a decomposable aggregate (counts, sums, flags), so Spark
combines map-side before the shuffle and no per-tender list is ever built.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import RE_NARROW, RE_WIDE, match_count, matches
from ..functions.times import floor_days
from .skew import HOT_ROWS, join_unique_dim


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def own_aggs() -> list[Column]:
    """Aggregates over question rows that need nothing of the tender."""
    desc, ans = F.col("description"), F.col("answer")
    days = floor_days("answered_ts", "asked_ts")
    n = F.count(F.lit(1))
    return [
        n.alias("n_questions"),
        F.count_if(_truthy(desc)).alias("num_pregu"),
        F.count_if(_truthy(ans)).alias("num_respu"),
        (F.count_if(_truthy(desc)) - F.count_if(_truthy(ans))).alias("qa_gap"),
        F.when(F.count(desc) == n,
               F.count_if(~matches(desc, RE_WIDE) & ans.isNull())).alias("unanswered_wide"),
        F.when(F.count(days) == n, F.avg(days)).alias("mean_response_days"),
    ]


def own_stats(enquiries: DataFrame, key: str = "tender_key") -> DataFrame:
    """``own_aggs`` per tender key: one grouping, no join."""
    return enquiries.groupBy(key).agg(*own_aggs())


def enquiry_aggs(compat_zero: bool = False) -> list[Column]:
    """All aggregates over one tender's question rows.

    Expects ``_in_ent`` and ``_enq_end`` (the tender's attributes) joined in.
    ``compat_zero`` reproduces the source's late-question count as it runs
    (always 0, its pattern is out of scope there).
    """
    desc, ans = F.col("description"), F.col("answer")
    late = F.count_if(~F.coalesce(F.col("asked_ts") <= F.col("_enq_end"), F.lit(False))
                      & (match_count(desc, RE_WIDE) != 1))
    kept_unanswered = (desc.isNotNull()
                       & ~F.col("author_id").contains(F.col("_in_ent"))
                       & ~matches(desc, RE_NARROW) & ans.isNull())
    narrow_unknown = (F.max(F.col("_in_ent").isNull())
                      | F.max(desc.isNotNull() & F.col("author_id").isNull()))
    return [
        *own_aggs(),
        (F.lit(0).cast("bigint") if compat_zero else late).alias("late_questions"),
        F.when(~narrow_unknown, F.count_if(kept_unanswered)).alias("unanswered_narrow"),
    ]


def enquiry_stats(enquiries: DataFrame, tenders: DataFrame, key: str = "tender_key",
                  in_ent_col: str = "in_ent", deadline_col: str = "enq_end",
                  compat_zero: bool = False, hot_rows: int = HOT_ROWS,
                  hot: DataFrame | None = None) -> DataFrame:
    """One row per tender key that has questions, all measures above.

    ``hot`` — precomputed hot keys (see ``skew.join_unique_dim``)."""
    facts = enquiries.select(key, "description", "answer", "author_id", "asked_ts",
                             "answered_ts")
    dims = tenders.select(key, F.col(in_ent_col).alias("_in_ent"),
                          F.col(deadline_col).alias("_enq_end"))
    j = join_unique_dim(facts, dims, key, hot_rows, hot=hot)
    return j.groupBy(key).agg(*enquiry_aggs(compat_zero))


def with_enquiry_stats(tenders: DataFrame, enquiries: DataFrame, key: str = "tender_key",
                       compat_zero: bool = False, hot_rows: int = HOT_ROWS,
                       hot: DataFrame | None = None) -> DataFrame:
    """Tenders left-joined to their question measures.

    A tender without questions gets NULL everywhere except
    ``late_questions``, which the source reports as 0 in that case.
    """
    stats = enquiry_stats(enquiries, tenders, key, compat_zero=compat_zero, hot_rows=hot_rows, hot=hot)
    out = tenders.join(stats, key, "left")
    return out.withColumn("late_questions", F.coalesce("late_questions", F.lit(0).cast("bigint")))
