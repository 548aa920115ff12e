"""Rules shared by all kernels: wrap-around integers, IEEE division, NaN guards."""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession, functions as F

from colonnade.types import Logical

ANSI = "spark.sql.ansi.enabled"


@contextmanager
def wrapping(spark: SparkSession):
    """DataFrames built inside wrap integers and saturate casts instead of raising.

    Spark fixes the mode when a plan is analysed, so the setting is restored at once.
    """
    before = spark.conf.get(ANSI)
    spark.conf.set(ANSI, "false")
    try:
        yield spark
    finally:
        spark.conf.set(ANSI, before)


def is_nan_literal(value) -> bool:
    return isinstance(value, float) and math.isnan(value)


def literal(value, t: Logical) -> Column:
    return F.lit(value).cast(t.spark)


def operand(value, t: Logical) -> Column:
    """A column stays as it is, anything else becomes a literal of type t."""
    return value if isinstance(value, Column) else literal(value, t)


def not_nan(x: Column, t: Logical) -> Column:
    """x with NaN as NULL, so that aggregates skip it."""
    return F.when(~F.isnan(x), x) if t.is_float else x


def ieee_divide(x: Column, y: Column) -> Column:
    """x / y with a signed infinity or NaN for a zero divisor."""
    return F.when(y == 0, x * F.pow(y, F.lit(-1))).otherwise(x / y)

