"""Calendar and timestamp functions (O-19, O-26, O-43).

Two weekday conventions exist in the reference and must never be mixed:
the batch features count Monday as 0, the online features count Sunday
as 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats tried in order when a timestamp string is parsed.
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy-MM-dd",
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_timestamp(s: Column | str, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """O-26: first format that parses wins; unparsable -> null.  The result
    is the wall-clock time as ``timestamp_ntz`` (independent of the session
    time zone: parse and conversion back use the same zone)."""
    s = _c(s)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def ntz_lit(dt) -> Column:
    """A ``timestamp_ntz`` literal for a naive Python datetime, built from
    its text so neither the Python nor the session time zone shifts it."""
    return F.lit(dt.isoformat(sep=" ")).cast("timestamp_ntz")


def batch_calendar(ts: Column | str) -> list[Column]:
    """O-19: hour, day_of_week (Mon=0), month, is_weekend."""
    ts = _c(ts)
    dow = F.weekday(ts)
    return [
        F.hour(ts).alias("hour"),
        dow.alias("day_of_week"),
        F.month(ts).alias("month"),
        (dow >= 5).cast("int").alias("is_weekend"),
    ]


def online_calendar(ts: Column | str, fallback: Column | str | None = None) -> list[Column]:
    """O-43: hour, day_of_week (Sun=0), month, is_weekend (Sat/Sun).

    ``fallback`` replaces an unparsable timestamp (an ingest-time column,
    never ``now()``, so results are reproducible).
    """
    ts = _c(ts)
    if fallback is not None:
        ts = F.coalesce(ts, _c(fallback))
    dow = F.dayofweek(ts) - 1
    return [
        F.hour(ts).alias("hour_of_day"),
        dow.alias("day_of_week"),
        F.month(ts).alias("month"),
        dow.isin(0, 6).alias("is_weekend"),
    ]


def seconds_between(earlier: Column | str, later: Column | str) -> Column:
    """Elapsed seconds (fractional) between two timestamps of one kind."""
    return F.timestamp_diff("MICROSECOND", _c(earlier), _c(later)) / 1e6
