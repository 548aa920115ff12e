"""Kernels against plain Python on NULL, NaN, infinities, signed zeros and the ends of integer ranges."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from colonnade.functions import stats
from colonnade.operators import agg, arith, cast, clip, compare, dates, unary
from colonnade.plans.frame import Frame
from colonnade.semantics import wrapping
from colonnade.streaming import windowed
from colonnade.types import DATE, F32, F64, I32, I64, STR, UnsupportedType

NAN, INF = math.nan, math.inf
VALUES = {
    I32: [None, 0, 1, -1, 2**31 - 1, -(2**31), 16777217],
    I64: [None, 0, 1, -1, 2**63 - 1, -(2**63), 2**53 + 1, 3037000500],
    F32: [None, NAN, INF, -INF, 0.0, -0.0, 1.5, -1.5, 2.5, -2.5, float(np.float32(-1.7)), float(np.float32(1e20)), float(np.float32(-1e20)), float(np.float32(1e-45))],
    F64: [None, NAN, INF, -INF, 0.0, -0.0, 1.5, -1.5, 2.5, -2.5, -1.7, 1e20, -1e20, 5e-324],
}
NP = {I32: np.int32, I64: np.int64, F32: np.float32, F64: np.float64}
TYPES = list(VALUES)
ids = lambda t: t.name


def run(spark, t, column, parts=3, values=None):
    values = VALUES[t] if values is None else values
    with wrapping(spark):
        rows = spark.createDataFrame(list(enumerate(values)), T.StructType([T.StructField("id", T.LongType()), T.StructField("x", t.spark)])).repartition(parts)
        return [r[1] for r in sorted(rows.select("id", column.alias("r")).collect())]


def same(a, b):
    if a is None or b is None:
        return a is b
    if isinstance(a, float) and math.isnan(a):
        return math.isnan(b)
    return a == b


@pytest.mark.parametrize("t", TYPES, ids=ids)
@pytest.mark.parametrize("lit", [0, 1, NAN])
@pytest.mark.parametrize("op", ["gt", "ge", "lt", "le", "eq", "neq"])
def test_predicates(spark, t, lit, op):
    if isinstance(lit, float) and t.is_int:
        return
    lit = float(lit) if t.is_float else lit
    want = {"gt": lambda v: v > lit, "ge": lambda v: v >= lit, "lt": lambda v: v < lit, "le": lambda v: v <= lit, "eq": lambda v: v == lit, "neq": lambda v: v != lit}[op]
    got = run(spark, t, getattr(compare, op)(F.col("x"), lit, t))
    assert got == [None if v is None else want(v) for v in VALUES[t]]


@pytest.mark.parametrize("t", [F32, F64], ids=ids)
def test_ranges(spark, t):
    assert run(spark, t, compare.bet(F.col("x"), -1.5, 2.5, t)) == [None if v is None else -1.5 <= v <= 2.5 for v in VALUES[t]]
    assert run(spark, t, compare.nbet(F.col("x"), -1.5, 2.5, t)) == [None if v is None else v < -1.5 or v > 2.5 for v in VALUES[t]]
    assert not any(run(spark, t, compare.bet(F.col("x"), 2.5, -1.5, t)))


@pytest.mark.parametrize("t", TYPES, ids=ids)
@pytest.mark.parametrize("lit", [0, 3])
@pytest.mark.parametrize("op", ["add", "sub", "mul", "div"])
def test_arithmetic(spark, t, lit, op):
    n = NP[t]
    q = NP[arith.QUOTIENT[t]]
    with np.errstate(all="ignore"):
        f = {"add": lambda v: np.add(n(v), n(lit)), "sub": lambda v: np.subtract(n(v), n(lit)), "mul": lambda v: np.multiply(n(v), n(lit)), "div": lambda v: np.divide(q(v), q(lit))}[op]
        want = [None if v is None else f(v).item() for v in VALUES[t]]
    got = run(spark, t, getattr(arith, op)(F.col("x"), lit, t))
    assert all(map(same, got, want)), (got, want)


@pytest.mark.parametrize("t", TYPES, ids=ids)
@pytest.mark.parametrize("op", ["sqrt", "sq", "abs_", "neg", "recip"])
def test_unary(spark, t, op):
    n, q = NP[t], NP[arith.QUOTIENT[t]]
    with np.errstate(all="ignore"):
        f = {"sqrt": lambda v: np.sqrt(q(v)), "sq": lambda v: n(v) * n(v), "abs_": lambda v: np.abs(n(v)), "neg": lambda v: -n(v), "recip": lambda v: q(1) / q(v)}[op]
        want = [None if v is None else f(v).item() for v in VALUES[t]]
    got = run(spark, t, getattr(unary, op)(F.col("x"), t))
    assert all(map(same, got, want)), (got, want)


@pytest.mark.parametrize("pair", cast.PAIRS, ids=lambda p: f"{p[0].name}-{p[1].name}")
def test_casts(spark, pair):
    a, b = pair

    def want(v):
        if v is None:
            return None
        if a.is_float and b.is_int:
            low, high = (-(2**31), 2**31 - 1) if b == I32 else (-(2**63), 2**63 - 1)
            return 0 if math.isnan(v) else low if v <= low else high if v >= high else math.trunc(v)
        return NP[b](v).item()

    assert all(map(same, run(spark, a, cast.cast(F.col("x"), a, b)), map(want, VALUES[a])))


@pytest.mark.parametrize("pair", clip.PAIRS, ids=lambda p: f"{p[0].name}-{p[1].name}")
def test_clip(spark, pair):
    t, b = pair
    want = [None if v is None else NP[b](v).item() if isinstance(v, float) and math.isnan(v) else min(max(NP[b](v).item(), -1), 2) for v in VALUES[t]]
    assert all(map(same, run(spark, t, clip.clip(F.col("x"), -1, 2, t, b)), want))
    assert run(spark, t, clip.clip(F.col("x"), 5, 4, t, b), values=[NP[t](1).item()]) == [4]


@pytest.mark.parametrize("parts", [1, 4, 64])
@pytest.mark.parametrize("t", TYPES, ids=ids)
def test_reductions(spark, t, parts):
    for values in (VALUES[t], [], [None, None], [NAN, NAN] if t.is_float else [None], [NAN, 2.0] if t.is_float else [5]):
        with wrapping(spark):
            df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("x", t.spark)])).repartition(parts)
            got = df.agg(*agg.min_max(F.col("x"), t), agg.sum_(F.col("x"), t)).head()
        known = [v for v in values if v is not None and not (isinstance(v, float) and math.isnan(v))]
        assert (got[0], got[1]) == (min(known, default=None), max(known, default=None))
        total = sum(known)
        if t.is_int:
            total = (total + 2**63) % 2**64 - 2**63
        assert same(got[2], total)


def test_dates_over_the_whole_calendar(spark):
    first = datetime.date(1, 1, 1)
    days = sorted({*range(0, 3652059, 97), 3652058, *((datetime.date(y, m, d) - first).days for y, m, d in ((1970, 1, 1), (1969, 12, 31), (1969, 12, 27), (1969, 12, 28), (2000, 2, 29), (1900, 3, 1), (2026, 3, 30)))})
    df = spark.createDataFrame([(first + datetime.timedelta(n),) for n in days], "d date")
    d = F.col("d")
    for r in df.select("d", dates.extract_year(d), dates.extract_month(d), dates.extract_day(d), dates.extract_day_of_week(d), dates.truncate_year(d), dates.truncate_month(d), dates.diff(d, F.lit(datetime.date(1970, 1, 1)))).collect():
        x = r[0]
        assert tuple(r[1:]) == (x.year, x.month, x.day, x.isoweekday() % 7, x.replace(month=1, day=1), x.replace(day=1), (x - datetime.date(1970, 1, 1)).days)


def test_rounding(spark):
    got = run(spark, F64, unary.round_(F.col("x"), F64), values=[0.5, 1.5, -2.5, NAN, INF, None])
    assert got[:3] == [0.0, 2.0, -2.0] and math.isnan(got[3]) and got[4:] == [INF, None]
    assert run(spark, F64, unary.round_(F.col("x"), F64, "half_up"), values=[0.5, 1.5, -2.5])[:3] == [1.0, 2.0, -3.0]


def test_types_without_kernels_are_refused():
    for call in (lambda: arith.add(F.col("x"), 1, STR), lambda: cast.cast(F.col("x"), F64, F32), lambda: unary.sqrt(F.col("x"), DATE), lambda: clip.clip(F.col("x"), 0, 1, F64, I64)):
        with pytest.raises(UnsupportedType):
            call()


def test_frame_and_statistics(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", NAN, 2), ("b", 3.0, 3), (None, None, None)], "g string, x double, n int")
    got = Frame(df).where(compare.ge, "n", 1).with_column("m", arith.mul, "n", 10).reduce(("g",), s=(agg.sum_, "x"), top=(agg.max_, "m")).df.collect()
    assert sorted(map(tuple, got)) == [("a", 1.0, 20), ("b", 3.0, 30)]
    d = stats.describe(df, "g", "x", "n").head()
    assert (d["g_maxlen"], d["x_count"], d["x_mean"], d["n_sum"], d["g_isascii"]) == (1, 2, 2.0, 6, True)
    for rows, want in (([], True), ([(1, 5), (2, 5), (3, 9)], True), ([(1, 5), (2, 4)], False), ([(1, 1), (2, None), (3, 2)], True)):
        assert stats.is_sorted(spark.createDataFrame(rows, "k int, x int"), "x", "k").head()[0] is want


def test_kernels_on_streams(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, 0, m), float(m)) for m in range(30)]
    spark.createDataFrame(rows, "ts timestamp, v double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, v double").parquet(f"{tmp_path}/in").where(compare.ge(F.col("v"), 5.0, F64))
    q = windowed(stream, "ts", "10 minutes", "1 minute", [], total=agg.sum_(F.col("v"), F64)).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.total for r in spark.table("w").collect()) == [35.0, 145.0, 245.0]


def test_days_and_dates(spark):
    d = datetime.date
    values = [None, d(1970, 1, 1), d(2000, 2, 29), d(1900, 3, 1), d(9999, 12, 30)]
    assert run(spark, DATE, arith.add(F.col("x"), 1, DATE), values=values) == [None, d(1970, 1, 2), d(2000, 3, 1), d(1900, 3, 2), d(9999, 12, 31)]
    assert run(spark, DATE, arith.sub(F.col("x"), F.col("id").cast("int"), DATE), values=values) == [None, d(1969, 12, 31), d(2000, 2, 27), d(1900, 2, 26), d(9999, 12, 26)]
    for lit in (d(2000, 2, 29), "2000-02-29"):
        assert run(spark, DATE, compare.ge(F.col("x"), lit, DATE), values=values) == [None, False, True, False, True]
    assert run(spark, DATE, compare.bet(F.col("x"), d(1900, 3, 1), d(1970, 1, 1), DATE), values=values) == [None, True, False, True, False]
    with pytest.raises(UnsupportedType):
        arith.mul(F.col("x"), 2, DATE)


def test_order_with_equal_keys(spark):
    rows = lambda *r: spark.createDataFrame(r, "k bigint, x string")
    assert stats.is_sorted(rows((1, "b"), (1, "a"), (2, "b")), "x", "k").head()[0]
    assert not stats.is_sorted(rows((1, "b"), (1, "a"), (2, "a")), "x", "k").head()[0]
    assert stats.is_sorted(rows(), "x", "k").head()[0]
