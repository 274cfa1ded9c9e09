"""Times as microseconds since 1970, whatever the session's zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Epoch numbers above this are milliseconds; the accepted years are 2000 to 2099.
MILLIS_FROM, FIRST_US, LAST_US = 1e11, 946_684_800_000_000, 4_102_444_800_000_000


def utc_micros(text: Column, fmt: str) -> Column:
    """A time without a zone, taken as UTC; null if it can't be read."""
    return F.unix_micros(F.try_to_timestamp(F.concat(text, F.lit(" +00:00")), F.lit(f"{fmt} XXX")))


def micros(text: Column, fmt: str) -> Column:
    """A time whose format has a zone."""
    return F.unix_micros(F.try_to_timestamp(text, F.lit(fmt)))


def rfc3339_micros(text: Column) -> Column:
    """``2026-11-19T22:42:01.5Z`` and offsets, a ``T`` or a blank between day and time; without a zone UTC."""
    iso = F.regexp_replace(F.replace(text, F.lit(" "), F.lit("T")), ",", ".")
    zone = F.when(iso.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    return F.when(zone.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), F.unix_micros(zone.try_cast("timestamp")))


def epoch_micros(number: Column) -> Column:
    """Seconds or milliseconds since 1970; null outside of 2000 to 2099."""
    us = F.round(F.when(F.abs(number) > MILLIS_FROM, number * 1e3).otherwise(number * 1e6)).cast("long")
    return F.when((us >= FIRST_US) & (us < LAST_US), us)


def year_of(us: Column) -> Column:
    return F.year(F.date_from_unix_date(F.floor(us / 86_400_000_000).cast("int")))


def without_year(month_day_time: Column, fmt: str, near_us: Column, year: int = 0) -> Column:
    """A time without its year: that of ``near_us``, or the one before where it would lie over a day later."""
    of = F.lit(year) if year else year_of(near_us)
    this = utc_micros(F.concat(of.cast("string"), F.lit(" "), month_day_time), f"yyyy {fmt}")
    if year:
        return this
    last = utc_micros(F.concat((of - 1).cast("string"), F.lit(" "), month_day_time), f"yyyy {fmt}")
    return F.when(this > near_us + 86_400_000_000, last).otherwise(this)
