"""Numeric casts. Inside `semantics.wrapping` floats saturate, truncate toward zero, NaN gives 0."""

from __future__ import annotations

from pyspark.sql import Column

from colonnade.types import F32, F64, I32, I64, Logical, UnsupportedType

PAIRS = ((I64, F64), (I32, F32), (F64, I64), (F32, I32), (F32, F64), (I32, I64), (I32, F64), (F32, I64), (I64, F32), (F64, I32))


def cast(x: Column, source: Logical, target: Logical) -> Column:
    if (source, target) not in PAIRS:
        raise UnsupportedType(f"no cast from {source.name} to {target.name}")
    return x.cast(target.spark)
