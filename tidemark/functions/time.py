"""Time as microseconds since 1970-01-01 UTC.  Zone-less columns are taken as UTC; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def micros(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def day_text(us: Column | str) -> Column:
    """``YYYY-MM-DD`` of microseconds."""
    us = F.col(us) if isinstance(us, str) else us
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd")


def floor_to(us: Column, step: int) -> Column:
    """The last multiple of ``step`` at or before ``us``, also before 1970."""
    return us - F.pmod(us, F.lit(step))
