"""Parts of dates and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _flag(c: Column) -> Column:
    """A missing time is no weekend and no month's end."""
    return F.coalesce(c.cast("int"), F.lit(0))


PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "dayofweek": F.weekday,  # Monday is 0
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "quarter": F.quarter,
    "dayofyear": F.dayofyear,
    "weekofyear": F.weekofyear,
    "is_weekend": lambda c: _flag(F.weekday(c) >= 5),
    "is_month_start": lambda c: _flag(F.dayofmonth(c) == 1),
    "is_month_end": lambda c: _flag(F.to_date(c) == F.last_day(c)),
}
