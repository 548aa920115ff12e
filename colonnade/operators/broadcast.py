"""Projection of one literal onto every row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colonnade.types import Logical


def fill(value, t: Logical) -> Column:
    return F.lit(value).cast(t.spark)


def fill_u8(value: int) -> Column:
    """Spark has no unsigned byte; the next wider type holds 0 to 255."""
    if not 0 <= value <= 255:
        raise ValueError("an unsigned byte is 0 to 255")
    return F.lit(value).cast("smallint")
