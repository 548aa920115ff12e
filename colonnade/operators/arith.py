"""Binary arithmetic with a literal or a column. Integers wrap inside `semantics.wrapping`."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colonnade.semantics import ieee_divide, operand
from colonnade.types import DATE, F32, F64, I32, I64, NUMERIC, Logical, require

#: Division of integers leaves in the float type of the same width.
QUOTIENT = {I32: F32, I64: F64, F32: F32, F64: F64}


def promote(x: Column, t: Logical) -> Column:
    """x in its quotient type. Adding zero keeps the optimizer from widening past the rounding to float."""
    q = QUOTIENT[require(t, *NUMERIC)]
    y = x.cast(q.spark)
    return y + F.lit(0).cast(q.spark) if t == I32 else y


def add(x: Column, other, t: Logical) -> Column:
    """Numbers, or whole days (32-bit) to a date."""
    if require(t, *NUMERIC, DATE) == DATE:
        return F.date_add(x, operand(other, I32))
    return x + operand(other, t)


def sub(x: Column, other, t: Logical) -> Column:
    """Numbers, or whole days (32-bit) from a date."""
    if require(t, *NUMERIC, DATE) == DATE:
        return F.date_sub(x, operand(other, I32))
    return x - operand(other, t)


def mul(x: Column, other, t: Logical) -> Column:
    require(t, *NUMERIC)
    return x * operand(other, t)


def div(x: Column, other, t: Logical) -> Column:
    q = QUOTIENT[require(t, *NUMERIC)]
    y = promote(other, t) if isinstance(other, Column) else operand(other, q)
    return ieee_divide(promote(x, t), y).cast(q.spark)
