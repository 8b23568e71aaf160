"""Calendar parts of a timestamp, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HOURS_PER_DAY = 24
DAYS_PER_YEAR = 365.25


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def day_index(ts: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(ts)


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def cycle(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value that repeats every ``period``."""
    angle = F.lit(2 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)
