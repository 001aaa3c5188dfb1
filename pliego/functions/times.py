"""Time rules (DT-1 … DT-6).

Source timestamps are ISO-8601 text with a UTC offset.  Two readings are used:

* the *instant* (``TIMESTAMP``) for every duration and comparison, and
* the *local wall clock* (``TIMESTAMP_NTZ``) for calendar fields such as the
  tender year, so ``2022-12-31T23:30:00-05:00`` belongs to 2022 whatever the
  session time zone is.

Durations follow timedelta arithmetic: whole days are the
*floor* of the elapsed time (−25 h is −2 days), minutes and hours are exact
fractions.  All conversions are ``try_cast`` so bad text gives NULL, never an
ANSI error.  Columns that already hold timestamps pass through unchanged.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampNTZType, TimestampType

from .util import as_col

_US_PER_DAY = 86_400_000_000.0
_US_PER_HOUR = 3_600_000_000.0
_US_PER_MINUTE = 60_000_000.0


def instant(c) -> Column:
    """Text (or timestamp) → TIMESTAMP instant; NULL for unparsable text."""
    return as_col(c).try_cast(TimestampType())


def wall_clock(c) -> Column:
    """Text (or timestamp) → TIMESTAMP_NTZ as written, offset ignored."""
    return as_col(c).try_cast(TimestampNTZType())


def elapsed_us(end, start) -> Column:
    """Signed microseconds from ``start`` to ``end`` (both already timestamps)."""
    return F.timestamp_diff("MICROSECOND", as_col(start), as_col(end))


def floor_days(end, start) -> Column:
    """Whole days ``end − start``, floored like ``timedelta.days`` (BIGINT)."""
    return F.floor(elapsed_us(end, start) / F.lit(_US_PER_DAY)).cast("bigint")


def hours_between(end, start) -> Column:
    """Exact hours ``end − start`` (DOUBLE) — the nf061 unit."""
    return elapsed_us(end, start) / F.lit(_US_PER_HOUR)


def minutes_between(end, start) -> Column:
    """Exact minutes ``end − start`` (DOUBLE) — the auction-period unit."""
    return elapsed_us(end, start) / F.lit(_US_PER_MINUTE)


def local_year(c) -> Column:
    """DT-1a: calendar year of the local wall clock (BIGINT)."""
    return F.year(wall_clock(c)).cast("bigint")


def date_year(c) -> Column:
    """DT-1b: ``YEAR(CAST(text AS DATE))`` with ``try_cast`` (BIGINT)."""
    return F.year(as_col(c).try_cast("date")).cast("bigint")


def iso_with_offset(ts, offset: str = "-05:00") -> Column:
    """Render a wall-clock timestamp as ISO-8601 text with a fixed offset."""
    return F.concat(F.date_format(as_col(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


def is_text(dtype) -> bool:
    return isinstance(dtype, StringType)


def timestamp_of(df, name: str) -> Column:
    """Column ``name`` of ``df`` as a timestamp: text is parsed to the instant,
    timestamp columns (with or without zone) are used as they are."""
    field = df.schema[name]
    return instant(name) if is_text(field.dataType) else F.col(name)
