"""Every catalogue entry against its SQL twin in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__
from colonnade.plans import catalog
from colonnade.sources import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(rows):
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


def test_inventory_is_whole():
    names = [e.name for e in catalog.kernels()]
    assert len(names) == len(set(names)) == 147  # 146 kernels and the date difference
    assert set(__spark_entry__.queries()) >= set(names)


@pytest.mark.parametrize("name", list(catalog.entries()))
def test_matches_sql(spark, duck, name):
    e = catalog.entries()[name]
    df = e.run(spark, DATA)
    relation = duck.sql(e.sql)
    order = sorted(df.columns)
    assert order == sorted(relation.columns)
    assert canonical(df.select(*order).collect()) == canonical(relation.select(*order).fetchall())


def test_no_python_in_plans(spark):
    for name in ("gt_f64", "div_i32_vec", "clip_f32_f32bounds", "sum_f64_valid", "selective_sum"):
        plan = catalog.entries()[name].run(spark, DATA)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_predicates_reach_the_scan(spark):
    plan = catalog.selective_sum(spark, DATA)._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,25.0)" in plan and "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double>" in plan


def test_settings_stay_as_they_were(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    catalog.entries()["mul_i64_vec"].run(spark, DATA)
    assert spark.conf.get("spark.sql.ansi.enabled") == before
