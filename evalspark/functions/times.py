"""Time expressions against a fixed clock (Q7, Q16, Q17, Q18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the clock every relative time query is read against
CLOCK_DATE = "2100-12-31"
CLOCK_TIME = "23:59:00"
CLOCK = f"{CLOCK_DATE} {CLOCK_TIME}"

_EPOCH = "1970-01-01 00:00:00"


def moment(text: str) -> Column:
    """A zone-free timestamp literal; folds to a constant, so it pushes down."""
    return F.lit(text).cast("timestamp_ntz")


def shift(ts: Column, months: int = 0, days: int = 0) -> Column:
    """``ts`` moved by calendar months and days; a missing day clamps to month end."""
    out = ts
    if months:
        out = out + F.make_ym_interval(F.lit(0), F.lit(months))
    if days:
        out = out + F.make_dt_interval(F.lit(days))
    return out


def shift_overflow(ts: Column, months: int) -> Column:
    """Month shift that rolls a missing day into the next month (2100-01-31 +1 -> 2100-03-03)."""
    past_first = F.make_dt_interval(F.dayofmonth(ts) - 1)
    return (ts - past_first) + F.make_ym_interval(F.lit(0), F.lit(months)) + past_first


def since(ts: Column, as_of: str = CLOCK, months: int = 0, days: int = 0) -> Column:
    """``ts`` is no older than the given span before the clock."""
    return ts >= shift(moment(as_of), -months, -days)


def in_years(ts: Column, first: int, last: int | None = None) -> Column:
    """Calendar-year test as a range on the raw column, so parquet filters can use it.

    ``last=None`` leaves the range open (``year >= first``).
    """
    test = ts >= moment(f"{first:04d}-01-01 00:00:00")
    if last is not None:
        test = test & (ts < moment(f"{last + 1:04d}-01-01 00:00:00"))
    return test


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp."""
    return F.timestamp_diff("MICROSECOND", moment(_EPOCH), ts.cast("timestamp_ntz"))


def julian_day_diff(later: Column, earlier: Column) -> Column:
    """Difference in days with its fraction, as ``julianday(later) - julianday(earlier)``."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86400e6)
