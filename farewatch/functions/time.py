"""Time helpers that stay inside whole-stage codegen and work on TIMESTAMP_NTZ.

Everything is wall-clock arithmetic on calendar fields and day-time intervals. None of it goes
through a zoned timestamp, so results do not depend on the session time zone and operators need
not change it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"


def _col(ts: Column | str) -> Column:
    return F.col(ts) if isinstance(ts, str) else ts


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970-01-01 for a TIMESTAMP_NTZ column."""
    ts = _col(ts)
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from ``start`` to ``end`` (both on whole seconds)."""
    return epoch_seconds(end) - epoch_seconds(start)


def seconds_after(ts: Column | str, seconds: Column | int) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return _col(ts) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def from_epoch_seconds(seconds: Column) -> Column:
    return seconds_after(F.lit(EPOCH).cast("timestamp_ntz"), seconds)


def floor_to_seconds(ts: Column | str, width: int) -> Column:
    """Tumbling bucket start aligned to the epoch (like pandas ``floor``)."""
    return from_epoch_seconds(F.floor(epoch_seconds(ts) / width) * width)


def instant(ts: Column | str) -> Column:
    """The TIMESTAMP whose UTC wall clock is ``ts``: event time of the streaming queries."""
    return F.timestamp_seconds(epoch_seconds(ts))


def iso_text(ts: Column | str) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` of a TIMESTAMP_NTZ on whole seconds."""
    return F.replace(_col(ts).cast("string"), F.lit(" "), F.lit("T"))


def day_text(ts: Column | str) -> Column:
    return F.to_date(_col(ts)).cast("string")


def month_text(ts: Column | str) -> Column:
    return F.substring(day_text(ts), 1, 7)
