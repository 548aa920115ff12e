"""Predicates. Ordered comparison: NaN fails everything but `neq`; NULL gives NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colonnade.semantics import is_nan_literal, operand
from colonnade.types import NUMERIC, DATE, Logical, require

ALLOWED = (*NUMERIC, DATE)


def _never(*cols: Column) -> Column:
    known = F.lit(True)
    for c in cols:
        known = known & c.isNotNull()
    return F.when(known, F.lit(False))


def _guard(mask: Column, t: Logical, *cols: Column) -> Column:
    # separate conjuncts, so that the comparison itself can still reach the scan
    if t.is_float:
        for c in cols:
            mask = ~F.isnan(c) & mask
    return mask


def _binary(x: Column, other, t: Logical, compare, guarded: bool) -> Column:
    require(t, *ALLOWED)
    if is_nan_literal(other):
        return _never(x)
    y = operand(other, t)
    columns = (x, y) if isinstance(other, Column) else (x,)
    return _guard(compare(x, y), t, *columns) if guarded or isinstance(other, Column) else compare(x, y)


def gt(x: Column, other, t: Logical) -> Column:
    return _binary(x, other, t, lambda a, b: a > b, True)


def ge(x: Column, other, t: Logical) -> Column:
    return _binary(x, other, t, lambda a, b: a >= b, True)


def lt(x: Column, other, t: Logical) -> Column:
    return _binary(x, other, t, lambda a, b: a < b, False)  # NaN sorts last, so it fails


def le(x: Column, other, t: Logical) -> Column:
    return _binary(x, other, t, lambda a, b: a <= b, False)


def eq(x: Column, other, t: Logical) -> Column:
    return _binary(x, other, t, lambda a, b: a == b, False)


def neq(x: Column, other, t: Logical) -> Column:
    require(t, *ALLOWED)
    if is_nan_literal(other):
        return F.when(x.isNotNull(), F.lit(True))
    mask = x != operand(other, t)
    if t.is_float and isinstance(other, Column):
        mask = mask | F.isnan(x) & other.isNotNull() | F.isnan(other) & x.isNotNull()
    return mask


def bet(x: Column, lo, hi, t: Logical) -> Column:
    """lo <= x <= hi."""
    require(t, *ALLOWED)
    if is_nan_literal(lo) or is_nan_literal(hi):
        return _never(x)
    columns = [c for c in (lo, hi) if isinstance(c, Column)]
    mask = (x >= operand(lo, t)) & (x <= operand(hi, t))
    return _guard(mask, t, x, *columns) if columns else mask


def nbet(x: Column, lo, hi, t: Logical) -> Column:
    """x < lo or x > hi; not the complement of `bet` on NaN."""
    require(t, *ALLOWED)
    if is_nan_literal(lo) and is_nan_literal(hi):
        return _never(x)
    below, above = lt(x, lo, t), gt(x, hi, t)
    return below | above
