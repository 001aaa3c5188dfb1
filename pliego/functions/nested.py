"""Per-release measures over nested arrays (higher-order functions).

In a release document the questions and the bids are arrays inside the row,
so every measure is a ``filter`` / ``exists`` / ``aggregate`` over that array:
no explode, no shuffle, all inside codegen.  ``operators.enquiries`` and
``operators.bids`` are the flat forms of the same measures; tests check that
both agree.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import ENQUIRY_DDL
from .text import RE_NARROW, RE_WIDE, match_count, matches
from .times import floor_days, instant
from .util import as_col


def typed_enquiries(v) -> Column:
    """VARIANT enquiries → ``ARRAY<STRUCT<...>>`` (NULL if not an array)."""
    return F.try_variant_get(as_col(v), "$", ENQUIRY_DDL)


def variant_items(v) -> Column:
    """VARIANT enquiries → ``ARRAY<VARIANT>`` (keeps key presence)."""
    return F.try_variant_get(as_col(v), "$", "array<variant>")


def array_len(a) -> Column:
    """AG-1: element count; NULL for a missing list."""
    return F.array_size(as_col(a)).cast("bigint")


def count_truthy(a) -> Column:
    """AG-2: elements that are not NULL and not ``''`` (NULL list → NULL)."""
    return F.array_size(F.filter(as_col(a), lambda x: x.isNotNull() & (x.cast("string") != ""))).cast("bigint")


def count_present(a) -> Column:
    """AG-2 for struct elements: non-NULL elements (NULL list → NULL)."""
    return F.array_size(F.filter(as_col(a), lambda x: x.isNotNull())).cast("bigint")


def unanswered_wide(v) -> Column:
    """AG-3 on VARIANT enquiries (the scoring pipeline's ``Pre_No_Respu``).

    NULL list or empty list → NULL.  When no question has an ``answer`` key:
    the number of questions (NULL if none has a ``description`` key).
    Otherwise NULL if any description is NULL or missing, else the questions
    without a wide-pattern match whose answer is an *explicit* null.
    """
    items = variant_items(v)
    desc = lambda e: F.variant_get(e, "$.description", "string")
    ans_v = lambda e: F.variant_get(e, "$.answer", "variant")
    has_answer_key = F.exists(items, lambda e: ans_v(e).isNotNull())
    has_desc_key = F.exists(items, lambda e: F.variant_get(e, "$.description", "variant").isNotNull())
    any_null_desc = F.exists(items, lambda e: desc(e).isNull())
    counted = F.array_size(F.filter(
        items, lambda e: ~matches(desc(e), RE_WIDE) & F.coalesce(F.is_variant_null(ans_v(e)), F.lit(False))))
    return (F.when(items.isNull() | (F.array_size(items) == 0), F.lit(None))
             .when(~has_answer_key, F.when(has_desc_key, F.array_size(items)))
             .when(any_null_desc, F.lit(None))
             .otherwise(counted)).cast("bigint")


def late_questions(q, deadline, compat_zero: bool = False) -> Column:
    """AG-5a (scoring ``NF039``): questions not asked by the deadline whose
    description does not match the wide pattern exactly once.  A NULL date or
    deadline counts as late; a NULL list counts 0."""
    if compat_zero:
        return F.lit(0).cast("bigint")
    end = as_col(deadline)
    n = F.array_size(F.filter(as_col(q), lambda x: ~F.coalesce(instant(x["date"]) <= end, F.lit(False))
                              & (match_count(x["description"], RE_WIDE) != 1)))
    return F.coalesce(n, F.lit(0)).cast("bigint")


def unanswered_narrow(q, in_ent) -> Column:
    """AG-5b (indicator ``NF039``): unanswered questions after dropping NULL
    descriptions, the buying entity's own questions and narrow-pattern
    matches.  NULL for a NULL/empty list, a NULL entity, a NULL author, or a
    NULL author id on a question that has a description."""
    q, ent = as_col(q), as_col(in_ent)
    bad = F.exists(q, lambda x: x["author"].isNull()
                   | (x["description"].isNotNull() & x["author"]["id"].isNull()))
    n = F.array_size(F.filter(q, lambda x: x["description"].isNotNull()
                              & ~x["author"]["id"].contains(ent)
                              & ~matches(x["description"], RE_NARROW) & x["answer"].isNull()))
    return (F.when(q.isNull() | (F.array_size(q) == 0) | ent.isNull() | bad, F.lit(None))
             .otherwise(n)).cast("bigint")


def mean_response_days(q) -> Column:
    """AG-4: mean floor-days from question to answer; NULL if the list is
    empty or any question lacks a parsable answer date."""
    days = F.transform(as_col(q), lambda x: floor_days(instant(x["dateAnswered"]), instant(x["date"])))
    total = F.aggregate(days, F.lit(0).cast("bigint"), lambda acc, d: acc + d)
    return (F.when(F.exists(days, lambda d: d.isNull()) | (F.array_size(days) == 0), F.lit(None))
             .otherwise(total / F.array_size(days)))


def late_bids(bids, close) -> Column:
    """AG-6 (``Nf030``): bids dated strictly after the close.  NULL for a
    NULL/empty list, or if a bid has no tenderer, no value or a bad date;
    a NULL close counts 0."""
    b, c = as_col(bids), instant(as_col(close))
    bad = F.exists(b, lambda x: x["tenderers"].isNull() | (F.array_size(x["tenderers"]) == 0)
                   | x["value"].isNull() | (x["date"].isNotNull() & instant(x["date"]).isNull()))
    n = F.array_size(F.filter(b, lambda x: instant(x["date"]) > c))
    return (F.when(b.isNull() | (F.array_size(b) == 0) | bad, F.lit(None))
             .otherwise(n)).cast("bigint")
