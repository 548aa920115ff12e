"""Unary maths. Roots and reciprocals of integers leave in the float of equal width."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colonnade.operators.arith import QUOTIENT, promote
from colonnade.types import NUMERIC, Logical, require


def sqrt(x: Column, t: Logical) -> Column:
    q = QUOTIENT[require(t, *NUMERIC)]
    return F.sqrt(promote(x, t)).cast(q.spark)


def sq(x: Column, t: Logical) -> Column:
    require(t, *NUMERIC)
    return x * x


def abs_(x: Column, t: Logical) -> Column:
    require(t, *NUMERIC)
    return F.abs(x)


def neg(x: Column, t: Logical) -> Column:
    require(t, *NUMERIC)
    return -x


def recip(x: Column, t: Logical) -> Column:
    q = QUOTIENT[require(t, *NUMERIC)]
    y = promote(x, t)
    return F.when(y == 0, F.pow(y, F.lit(-1))).otherwise(F.lit(1).cast(q.spark) / y).cast(q.spark)


def round_(x: Column, t: Logical, mode: str = "half_even") -> Column:
    """Round floats to whole numbers: `half_even` (default) or `half_up`; the type stays."""
    require(t, *(n for n in NUMERIC if n.is_float))
    if mode == "half_even":
        return F.rint(x).cast(t.spark)
    if mode == "half_up":
        return F.when(F.isnan(x), x).otherwise(F.signum(x) * F.floor(F.abs(x) + 0.5)).cast(t.spark)
    raise ValueError(f"unknown rounding mode {mode}")
