"""Mask algebra and counting of selected rows; NULL is not selected."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def both(a: Column, b: Column) -> Column:
    return a & b


def either(a: Column, b: Column) -> Column:
    return a | b


def count_both(a: Column, b: Column) -> Column:
    return F.count_if(a & b)


def count_either(a: Column, b: Column) -> Column:
    return F.count_if(a | b)


def count_set(a: Column) -> Column:
    return F.count_if(a)


def byte_and(a: Column, b: Column) -> Column:
    """The mask a & b for integer columns that hold packed bits."""
    return a.bitwiseAND(b)


def byte_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def byte_and_count(a: Column, b: Column) -> Column:
    """Set bits of a & b for integer columns that hold packed bits."""
    return F.bit_count(a.bitwiseAND(b))


def byte_or_count(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseOR(b))


def is_na(x: Column) -> Column:
    return x.isNull()


def not_na(x: Column) -> Column:
    return x.isNotNull()


def is_na_binary(x: Column) -> Column:
    return x.isNull().cast("tinyint")


def not_na_binary(x: Column) -> Column:
    return x.isNotNull().cast("tinyint")
