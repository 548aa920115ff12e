"""String functions; NULL in any argument gives NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def to_upper(s: Column) -> Column:
    return F.upper(s)


def to_lower(s: Column) -> Column:
    return F.lower(s)


def to_title(s: Column) -> Column:
    """The first letter of each word in upper case, the rest in lower case."""
    return F.initcap(s)


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def strip(s: Column) -> Column:
    """Spaces off both ends."""
    return F.trim(s)


def strip_left(s: Column) -> Column:
    return F.ltrim(s)


def strip_right(s: Column) -> Column:
    return F.rtrim(s)


def str_len(s: Column) -> Column:
    """Characters."""
    return F.char_length(s)


def eq(a: Column, b) -> Column:
    return a == b


def contains(a: Column, b) -> Column:
    return F.contains(a, b if isinstance(b, Column) else F.lit(b))
