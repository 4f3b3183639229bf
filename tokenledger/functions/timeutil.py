"""Timestamp literals that do not depend on the Python process's time zone.

``F.lit(datetime)`` converts a naive datetime with the *process* zone; an ISO
string cast in SQL uses the *session* zone, like every other timestamp here.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_lit(value) -> Column:
    """A TIMESTAMP literal from a datetime, date or ISO string (session zone)."""
    if isinstance(value, Column):
        return value.cast("timestamp")
    if isinstance(value, dt.datetime):
        text = value.replace(tzinfo=None).isoformat(sep=" ")
    elif isinstance(value, dt.date):
        text = value.isoformat() + " 00:00:00"
    else:
        text = str(value)
    return F.lit(text).cast("timestamp")


def millis(seconds) -> Column:
    """Whole milliseconds of a duration in seconds, cut toward zero."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return (c.cast("double") * 1000).cast("bigint")
