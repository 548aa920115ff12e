"""Calendar parts and truncation of dates. Day of week: 0 is Sunday."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def extract_year(d: Column) -> Column:
    return F.year(d)


def extract_month(d: Column) -> Column:
    return F.month(d)


def extract_day(d: Column) -> Column:
    return F.dayofmonth(d)


def extract_day_of_week(d: Column) -> Column:
    return F.dayofweek(d) - F.lit(1)


def truncate_year(d: Column) -> Column:
    return F.trunc(d, "YEAR")


def truncate_month(d: Column) -> Column:
    return F.trunc(d, "MM")


def diff(a: Column, b: Column) -> Column:
    """Days from b to a."""
    return F.datediff(a, b)
