"""Clamp to [lo, hi]; NULL and NaN pass through. lo > hi gives hi."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colonnade.semantics import literal
from colonnade.types import F32, F64, I32, I64, Logical, UnsupportedType

PAIRS = ((F64, F64), (F32, F32), (I32, I32), (I64, I64), (I64, F64), (I32, F32))


def clip(x: Column, lo, hi, t: Logical, bounds: Logical | None = None) -> Column:
    """bounds: the type of lo and hi, and of the result; that of x by default."""
    bounds = bounds or t
    if (t, bounds) not in PAIRS:
        raise UnsupportedType(f"no clip of {t.name} with bounds of {bounds.name}")
    y = x.cast(bounds.spark)
    keep = y.isNull() | F.isnan(y) if bounds.is_float else y.isNull()
    return F.when(keep, y).otherwise(F.least(F.greatest(y, literal(lo, bounds)), literal(hi, bounds)))
