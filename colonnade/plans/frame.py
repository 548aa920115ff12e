"""A thin facade that looks column types up and builds inside wrap-around semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from colonnade.semantics import wrapping
from colonnade.types import Logical, column_type


class Frame:
    """Frame(df).where(compare.gt, "x", 3).with_column("y", arith.add, "x", 1).df"""

    def __init__(self, df: DataFrame):
        self.df = df

    def type(self, name: str) -> Logical:
        return column_type(self.df, name)

    def _column(self, op: Callable[..., Column], name: str, *args, **options) -> Column:
        return op(F.col(name), *args, self.type(name), **options)

    def where(self, op: Callable[..., Column], name: str, *args) -> Frame:
        with wrapping(self.df.sparkSession):
            return Frame(self.df.where(self._column(op, name, *args)))

    def with_column(self, to: str, op: Callable[..., Column], name: str, *args, **options) -> Frame:
        with wrapping(self.df.sparkSession):
            return Frame(self.df.withColumn(to, self._column(op, name, *args, **options)))

    def reduce(self, keys: tuple[str, ...] = (), **ops: tuple[Callable[..., Column], str]) -> Frame:
        """ops: result name = (reduction, column); grouped if keys are given."""
        with wrapping(self.df.sparkSession):
            out = [self._column(op, name).alias(to) for to, (op, name) in ops.items()]
            return Frame(self.df.groupBy(*keys).agg(*out))
