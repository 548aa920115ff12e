"""Reductions that skip NULL and NaN; usable under agg, groupBy, cube, rollup and over.

min and max of nothing are NULL; sum of nothing is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colonnade.semantics import not_nan
from colonnade.types import DATE, F64, I64, NUMERIC, Logical, require


def max_(x: Column, t: Logical) -> Column:
    require(t, *NUMERIC, DATE)
    return F.max(not_nan(x, t))


def min_(x: Column, t: Logical) -> Column:
    require(t, *NUMERIC, DATE)
    return F.min(not_nan(x, t))


def min_max(x: Column, t: Logical) -> tuple[Column, Column]:
    """Both bounds for one agg() call, which reads the data once."""
    return min_(x, t), max_(x, t)


def sum_(x: Column, t: Logical) -> Column:
    """bigint for integers (wrapping), double for floats."""
    wide = I64 if require(t, *NUMERIC).is_int else F64
    return F.coalesce(F.sum(not_nan(x, t)), F.lit(0).cast(wide.spark))
