"""Harvested search-page rows (HV-1, HV-2, HV-3, JN-1).

The source system fetched, for every tender, the first result row of a
public search page and parsed its HTML.  Here the fetched HTML fragments are
a table (one ``fragment`` per row); parsing, the "first half-year window
with a hit" rule and the join back to tenders are Spark operations.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import (HARVEST_BASE_URL, HARVEST_COLUMNS, first_link, no_spaces,
                              process_code, strip_tags, text_lines)
from ..functions.times import local_year

FIELDS = HARVEST_COLUMNS[1:]  # the seven text fields after the link


def parse_fragments(fragments: DataFrame, col: str = "fragment",
                    base_url: str = HARVEST_BASE_URL) -> DataFrame:
    """HV-3: fragment → link + seven fields, all text.

    Tags are stripped, the text is split into lines, the first line (empty,
    before the first field) is dropped and ``&nbsp;`` is removed from the
    last line only.  Fields are taken by position; spaces are removed from
    the code.  Other input columns are kept.
    """
    lines = text_lines(strip_tags(F.col(col)))
    n = F.size(lines)
    last_clean = F.replace(F.element_at(lines, -1), F.lit("&nbsp;"), F.lit(""))
    cleaned = F.when(n > 0, F.concat(F.slice(lines, 1, n - 1), F.array(last_clean))).otherwise(lines)
    cols = [first_link(F.col(col), base_url).alias("link")]
    for i, name in enumerate(FIELDS, start=1):
        v = F.get(cleaned, i)
        cols.append((no_spaces(v) if name == "codigo" else v).alias(name))
    rest = [c for c in fragments.columns if c != col]
    return fragments.select(*rest, *cols)


def tender_codes(tenders: DataFrame, ocid: str = "ocid", start: str = "start_ts") -> DataFrame:
    """PR-12 / ST-1: ``(ocid, codigo, Year)`` of each tender."""
    return tenders.select(ocid, process_code(F.col(ocid)).alias("codigo"),
                          local_year(start).alias("Year"))


def harvest_join(tenders: DataFrame, harvested: DataFrame, key: str = "codigo",
                 require_unique: bool = False) -> DataFrame:
    """JN-1: inner equi-join on the process code.

    A code harvested more than once counts with its first row (the source
    raised instead): earliest publish date, rows without one last, then
    ``page_id``.  The harvested ``date`` is already ``publish_date`` so no name
    clashes.  ``require_unique`` restores the strict behaviour: one
    aggregation job per side looks for a repeated code and raises if it
    finds one.
    """
    if require_unique:
        for side, df in (("tenders", tenders), ("harvested", harvested)):
            dup = df.groupBy(key).count().where(F.col("count") > 1).select(key).limit(1).collect()
            if dup:
                raise ValueError(f"{side}: {key} {dup[0][0]!r} is not unique")
    return tenders.join(first_per_code(harvested, key), key, "inner")


def first_per_code(harvested: DataFrame, key: str = "codigo") -> DataFrame:
    """One row per code: the first by publish date and ``page_id`` (a ``min`` over a struct, combined map-side)."""
    pub = F.col("publish_date").try_cast("date")
    rest = [c for c in harvested.columns if c != key]
    order = [pub.isNull().alias("_none"), pub.alias("_pub")] + [F.col(c) for c in ("page_id",) if c in rest]
    row = F.struct(*order, F.struct(*rest).alias("_row"))
    return (harvested.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("_first"))
            .select(key, *[F.col("_first._row")[c].alias(c) for c in rest]))


def harvested_codes(harvested: DataFrame) -> DataFrame:
    """Distinct ``(codigo, Year)`` of harvested rows with a publish date."""
    pub = F.col("publish_date").try_cast("date")
    return (harvested.where(pub.isNotNull())
            .select("codigo", F.year(pub).cast("bigint").alias("Year")).distinct())


def first_window_match(codes: DataFrame, harvested: DataFrame) -> DataFrame:
    """HV-1: for each ``(codigo, Year)`` the first half-year window with a hit.

    The year is searched in two windows, 1 Jan – 30 Jun then 1 Jul – 31 Dec;
    the first window holding a row for the code wins and its first row is
    kept (ordered by publish date, then ``page_id``).  Picking "the first" is
    a ``min`` over a struct, which Spark aggregates map-side, so a code with
    a huge number of rows never lands whole in one task.
    """
    firsts = first_rows(harvested)
    # inner join with the distinct keys (= a semi-join): Catalyst pushes a
    # semi-join below the aggregate, which would join a hot code row by row;
    # an inner join keeps the map-side aggregate first
    wanted = codes.select("codigo", "Year").distinct()
    return window_columns(firsts.join(wanted, ["codigo", "Year"], "inner"))


def first_rows(harvested: DataFrame) -> DataFrame:
    """``(codigo, Year, hit)``: the first row per code and year, ordered by
    half-year window, publish date, ``page_id`` (a ``min`` over a struct)."""
    pub = F.col("publish_date").try_cast("date")
    h = harvested.select(
        "codigo", F.year(pub).cast("bigint").alias("Year"),
        F.struct(F.when(F.month(pub) <= 6, 0).otherwise(1).alias("half"),
                 pub.alias("pub"), "page_id", *HARVEST_COLUMNS).alias("row"))
    return (h.where(F.col("row.pub").isNotNull())
             .groupBy("codigo", "Year").agg(F.min("row").alias("hit")))


def window_columns(found: DataFrame) -> DataFrame:
    """Output columns of ``first_window_match`` from ``(codigo, Year, hit)``."""
    start = F.make_date(F.col("Year").cast("int"), F.col("hit.half") * 6 + 1, F.lit(1))
    return found.select(
        "codigo", "Year",
        start.alias("window_start"),
        F.date_sub(F.add_months(start, 6), 1).alias("window_end"),
        "hit.page_id", *[F.col("hit")[c].alias(c) for c in HARVEST_COLUMNS if c != "codigo"])


def found_codes(codes: DataFrame, matches: DataFrame, how: str = "left_semi") -> DataFrame:
    """HV-2: tenders whose code was found (``left_anti`` for the missing ones)."""
    return codes.join(matches.select("codigo", "Year"), ["codigo", "Year"], how)
