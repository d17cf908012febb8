"""Times in UTC, whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


DAY_US = 86_400_000_000


def _parts(time_us: Column | str) -> tuple[Column, Column]:
    """Whole days since 1970, and microseconds of the day."""
    micros = F.col(time_us) if isinstance(time_us, str) else time_us
    rest = F.pmod(micros, F.lit(DAY_US))
    return ((micros - rest) / DAY_US).cast("int"), rest


def utc(time_us: Column | str) -> Column:
    """Microseconds since 1970 as a timestamp without zone, in UTC."""
    days, rest = _parts(time_us)
    start = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("timestamp_ntz")
    return start + F.make_dt_interval(secs=(rest / 1_000_000).cast("decimal(18,6)"))


def text(time_us: Column | str) -> Column:
    """RFC 3339 with microseconds."""
    return F.date_format(utc(time_us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def day(time_us: Column | str) -> Column:
    """The UTC date, as text."""
    return F.date_add(F.lit("1970-01-01").cast("date"), _parts(time_us)[0]).cast("string")
