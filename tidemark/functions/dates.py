"""Calendar Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def third_friday(month: Column) -> Column:
    """Of the month that a date lies in."""
    return F.date_add(F.next_day(F.last_day(F.add_months(month, -1)), "FRI"), 14)


def last_friday(month: Column) -> Column:
    return F.date_sub(F.next_day(F.last_day(month), "FRI"), 7)


def last_business_day(month: Column) -> Column:
    end = F.last_day(month)
    return F.date_sub(end, F.when(F.dayofweek(end) == 1, 2).when(F.dayofweek(end) == 7, 1).otherwise(0))


def is_weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7)
