"""Logical element types and their Spark counterparts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T


@dataclass(frozen=True)
class Logical:
    name: str
    spark: T.DataType
    width: int  # bytes, 0 when the width is not fixed

    @property
    def is_float(self) -> bool:
        return self.name in ("f32", "f64")

    @property
    def is_int(self) -> bool:
        return self.name in ("i32", "i64")

    @property
    def is_numeric(self) -> bool:
        return self.is_float or self.is_int

    @property
    def sql(self) -> str:
        return self.spark.simpleString()


NULL = Logical("null", T.NullType(), 0)
I32 = Logical("i32", T.IntegerType(), 4)
I64 = Logical("i64", T.LongType(), 8)
F32 = Logical("f32", T.FloatType(), 4)
F64 = Logical("f64", T.DoubleType(), 8)
DATE = Logical("date", T.DateType(), 4)
BOOL = Logical("bool", T.BooleanType(), 1)
STR = Logical("str", T.StringType(), 0)

ALL = (NULL, I32, I64, F32, F64, DATE, BOOL, STR)
NUMERIC = (I32, I64, F32, F64)


class UnsupportedType(TypeError):
    """No kernel exists for this combination of operation and type."""


def of(spark_type: T.DataType) -> Logical:
    for t in ALL:
        if t.spark == spark_type:
            return t
    raise UnsupportedType(f"no logical type for {spark_type.simpleString()}")


def column_type(df: DataFrame, name: str) -> Logical:
    return of(df.schema[name].dataType)


def require(t: Logical, *allowed: Logical) -> Logical:
    if t not in allowed:
        raise UnsupportedType(f"{t.name} is not one of {', '.join(a.name for a in allowed)}")
    return t
