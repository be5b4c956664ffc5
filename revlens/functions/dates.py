"""Date and time helpers (Column -> Column).

Timestamps stay ``timestamp_ntz`` end to end so no result depends on the
session time zone; elapsed time is measured with ``timestampdiff`` in
microseconds, which is exact for both ``timestamp`` and ``timestamp_ntz``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.functions._col import as_col

_US_PER_DAY = 86_400_000_000.0
_US_PER_HOUR = 3_600_000_000.0


def parse_strict(c) -> Column:
    """Text -> timestamp; malformed text raises under ANSI (``x::timestamp``)."""
    return as_col(c).cast("timestamp_ntz")


def parse_coerce(c) -> Column:
    """Text -> timestamp; malformed text becomes NULL (``errors='coerce'``).
    Parsed straight to ``timestamp_ntz``, so no local time is ever shifted
    by a time-zone rule."""
    return as_col(c).try_cast("timestamp_ntz")


def wall_clock_micros(ts) -> Column:
    """Microseconds since 1970-01-01 00:00 of the wall-clock value of a
    ``timestamp_ntz``, from its date and time fields. Unlike
    ``timestampdiff``, this never consults the session time zone, so a
    daylight-saving change cannot move a difference by an hour."""
    ts = as_col(ts)
    secs = F.date_part(F.lit("SECOND"), ts)  # seconds with microsecond fraction
    return (F.unix_date(F.to_date(ts)).cast("bigint") * F.lit(86_400_000_000)
            + (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * F.lit(1_000_000)
            + (secs * 1_000_000).cast("bigint"))


def elapsed_micros(end, start) -> Column:
    """``end - start`` in microseconds (time-zone independent)."""
    return wall_clock_micros(end) - wall_clock_micros(start)


def fractional_days(end, start) -> Column:
    """``EXTRACT(EPOCH FROM end - start) / 86400`` as double."""
    return elapsed_micros(end, start) / F.lit(_US_PER_DAY)


def floored_days(end, start) -> Column:
    """pandas ``(end - start).dt.days``: floor of elapsed days (toward -inf)."""
    return F.floor(elapsed_micros(end, start) / F.lit(_US_PER_DAY)).cast("bigint")


def elapsed_hours(end, start) -> Column:
    """pandas ``.dt.total_seconds() / 3600``."""
    return elapsed_micros(end, start) / F.lit(_US_PER_HOUR)


def calendar_days(end, start) -> Column:
    """``end::date - start::date`` as an integer day count."""
    return F.datediff(F.to_date(as_col(end)), F.to_date(as_col(start)))


def month_start(ts) -> Column:
    """``DATE_TRUNC('month', ts)`` as a time-zone-free timestamp."""
    return F.trunc(F.to_date(as_col(ts)), "month").cast("timestamp_ntz")


def minus_months(ts, months: int) -> Column:
    """Calendar-month subtraction (end-of-month clamps, like SQL intervals)."""
    return as_col(ts) - F.make_ym_interval(F.lit(0), F.lit(months))


def minus_days(ts, days: int) -> Column:
    return as_col(ts) - F.make_dt_interval(F.lit(days))


def plus_days(ts, days: int) -> Column:
    return as_col(ts) + F.make_dt_interval(F.lit(days))


def avg_days_exact(micros, weight=None) -> Column:
    """Aggregate: mean of an elapsed time given in integer microseconds, in
    days. The sum is exact (decimal), so the mean does not depend on
    summation order (PostgreSQL numeric semantics); ``weight`` repeats a row
    ``weight`` times."""
    us = as_col(micros)
    w = F.lit(1) if weight is None else as_col(weight)
    total = F.sum(us.cast("decimal(38,0)") * w.cast("decimal(38,0)"))
    count = F.sum(F.when(us.isNotNull(), w).cast("decimal(38,0)"))
    return (total / count).cast("double") / F.lit(_US_PER_DAY)
