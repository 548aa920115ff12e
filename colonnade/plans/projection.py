"""A projection of `lineitem` with a column of every kernel type, NULL and NaN included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colonnade.sources import read

#: Valid in Spark SQL and DuckDB alike. x: clean, n: with NULL and NaN, y: second operand.
COLUMNS = """l_orderkey AS k1, l_linenumber AS k2,
 l_linenumber AS xi32, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber END AS ni32, cast(l_suppkey AS int) AS yi32,
 l_orderkey AS xi64, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_partkey - 50 END AS ni64, l_suppkey AS yi64,
 cast(l_tax * 10 AS float) AS xf32, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 5 THEN cast('NaN' AS float) ELSE cast(l_tax * 10 AS float) END AS nf32, cast(l_quantity AS float) AS yf32,
 l_extendedprice AS xf64, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 5 THEN cast('NaN' AS double) ELSE l_quantity END AS nf64, l_discount + 0.0 AS yf64,
 cast(l_shipdate AS date) AS dt, cast('2000-02-29' AS date) AS dt2, l_quantity > 25 AS m1, l_discount > 0.05 AS m2, l_returnflag AS s1, l_linestatus AS s2"""


def typed(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").selectExpr(*_split(COLUMNS))


def typed_sql() -> str:
    return f"(SELECT {COLUMNS} FROM lineitem)"


def _split(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]
