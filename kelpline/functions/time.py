"""Time in whole seconds and nanoseconds, the engine's canonical key; Spark timestamps hold microseconds only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 1_000_000_000


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def seconds_of(ts: str | Column) -> Column:
    return F.floor(F.unix_micros(_c(ts).cast("timestamp")) / 1_000_000).cast("long")


def nanos_of(ts: str | Column) -> Column:
    return (F.pmod(F.unix_micros(_c(ts).cast("timestamp")), F.lit(1_000_000)) * 1000).cast("int")


def instant(seconds: str | Column, nanos: str | Column) -> Column:
    """The pair as a struct: structs compare field by field, which is the order of time."""
    return F.struct(_c(seconds).cast("long").alias("epoch_seconds"), _c(nanos).cast("int").alias("nanoseconds"))


def elapsed_ns(s1: str | Column, n1: str | Column, s2: str | Column, n2: str | Column) -> Column:
    """Nanoseconds from the first instant to the second; the borrow comes out by itself."""
    return (_c(s2) - _c(s1)) * F.lit(NANOS) + (_c(n2) - _c(n1)).cast("long")


def add_ns(seconds: str | Column, nanos: str | Column, ns: Column) -> tuple[Column, Column]:
    """The instant ns (decimal or long, not negative) later, with carry."""
    total = _c(nanos).cast("decimal(38,0)") + ns.cast("decimal(38,0)")
    carry = F.floor(total / NANOS).cast("long")
    return _c(seconds) + carry, (total - carry.cast("decimal(38,0)") * NANOS).cast("int")


def epoch_from_year(year: str | Column, seconds_into_year: str | Column) -> Column:
    """Unix seconds of a year's beginning in UTC plus an offset. A year before 1970 gives null; in readers it is an error."""
    days = F.datediff(F.make_date(_c(year).cast("int"), F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date"))
    return F.when(_c(year) >= 1970, days.cast("long") * 86400 + _c(seconds_into_year).cast("long"))


def is_leap_year(year: str | Column) -> Column:
    y = _c(year)
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def iso8601_millis(ts: str | Column) -> Column:
    """UTC with three decimals, cut off rather than rounded; the session's time zone is UTC."""
    return F.date_format(F.date_trunc("MILLISECOND", _c(ts).cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
