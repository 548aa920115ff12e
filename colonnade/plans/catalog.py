"""One definition per kernel: its Spark builder, its SQL and what it returns.

`entries()` feeds the driver's queries and their SQL twins, so that the two cannot drift.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colonnade.functions import stats, strings
from colonnade.operators import agg, arith, broadcast, cast, clip, compare, dates, masks, unary
from colonnade.plans.projection import typed, typed_sql
from colonnade.semantics import wrapping
from colonnade.sources import read
from colonnade.types import BOOL, DATE, F32, F64, I32, I64, NUMERIC, STR, Logical

LIT = {I32: 3, I64: 500, F32: 0.5, F64: 20.5}
LO = {I32: 2, I64: 400, F32: 0.25, F64: 10.0}
HI = {I32: 5, I64: 900, F32: 0.75, F64: 40.0}


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Ref(str):
    """A column's name; the column is made when a query is built, as that needs a session."""


def later(op: Callable[..., Column], *args, then: Callable[[Column], Column] = lambda c: c, **options) -> Callable[[], Column]:
    return lambda: then(op(*(F.expr(a) if isinstance(a, Ref) else a for a in args), **options))


def _row(name: str, column: Callable[[], Column], sql: str) -> Entry:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        with wrapping(spark):
            return typed(spark, folder).select("k1", "k2", column().alias("result"))

    return Entry(name, run, f"SELECT k1, k2, {sql} AS result FROM {typed_sql()}")


def _agg(name: str, **results: tuple[Callable[[], Column], str]) -> Entry:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        with wrapping(spark):
            return typed(spark, folder).agg(*(c().alias(k) for k, (c, _) in results.items()))

    return Entry(name, run, f"SELECT {', '.join(f'{s} AS {k}' for k, (_, s) in results.items())} FROM {typed_sql()}")


def _n(t: Logical) -> Ref:
    return Ref(f"n{t.name}")


def _y(t: Logical) -> Ref:
    return Ref(f"y{t.name}")


def _lit(value, t: Logical) -> str:
    return f"cast({value} AS {t.sql})"


def _plus_zero(t: Logical) -> Callable[[Column], Column]:
    """The sign of a zero is not the same in all engines' hashes."""
    return lambda c: c + F.lit(0).cast(t.spark)


def _summed(c: Column) -> Column:
    return F.sum(c)


def _rounded(places: int) -> Callable[[Column], Column]:
    return lambda c: F.round(c, places)


def _masks() -> list[Entry]:
    m1, m2 = Ref("m1"), Ref("m2")
    count = lambda c: f"count(*) FILTER (WHERE {c})"
    return [
        _agg("bit_wise_and_popcount", result=(later(masks.count_both, m1, m2), count("m1 AND m2"))),
        _agg("bit_wise_or_popcount", result=(later(masks.count_either, m1, m2), count("m1 OR m2"))),
        _agg("pop_count", result=(later(masks.count_set, m1), count("m1"))),
    ]


def _broadcasts() -> list[Entry]:
    out = [_row("broadcast_u8", later(broadcast.fill_u8, 200), "cast(200 AS smallint)")]
    return out + [_row(f"broadcast_{t.name}", later(broadcast.fill, LIT[t], t), _lit(LIT[t], t)) for t in NUMERIC]


def _filters() -> list[Entry]:
    out = []
    for t in NUMERIC:
        x, known = _n(t), f"NOT isnan({_n(t)}) AND " if t.is_float else ""
        lit, lo, hi = _lit(LIT[t], t), _lit(LO[t], t), _lit(HI[t], t)
        for op, sign in (("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<="), ("eq", "="), ("neq", "<>")):
            guard = known if sign[0] == ">" else ""
            out.append(_row(f"{op}_{t.name}", later(getattr(compare, op), x, LIT[t], t), f"({guard}{x} {sign} {lit})"))
        out.append(_row(f"bet_{t.name}", later(compare.bet, x, LO[t], HI[t], t), f"({x} BETWEEN {lo} AND {hi})"))
        out.append(_row(f"nbet_{t.name}", later(compare.nbet, x, LO[t], HI[t], t), f"({known}{x} NOT BETWEEN {lo} AND {hi})"))
    return out


def _arithmetic() -> list[Entry]:
    out = []
    for t in NUMERIC:
        x, q = _n(t), arith.QUOTIENT[t]
        for form, value, sql in (("lit", LIT[t], _lit(LIT[t], t)), ("vec", _y(t), _y(t))):
            for op, sign in (("add", "+"), ("sub", "-"), ("mul", "*")):
                out.append(_row(f"{op}_{t.name}_{form}", later(getattr(arith, op), x, value, t, then=_plus_zero(t)), f"{x} {sign} {sql} + cast(0 AS {t.sql})"))
            out.append(_row(f"div_{t.name}_{form}", later(arith.div, x, value, t), f"cast({x} AS {q.sql}) / cast({sql} AS {q.sql})"))
    return out


def _unary() -> list[Entry]:
    out = []
    for t in NUMERIC:
        x, q = _n(t), arith.QUOTIENT[t]
        out += [
            # DuckDB raises on roots of negative numbers; the tests sweep those
            _row(f"sqrt_{t.name}", later(unary.sqrt, Ref(f"abs({x})"), t), f"cast(sqrt(cast(abs({x}) AS {q.sql})) AS {q.sql})"),
            _row(f"sq_{t.name}", later(unary.sq, x, t), f"{x} * {x}"),
            _row(f"abs_{t.name}", later(unary.abs_, x, t), f"abs({x})"),
            _row(f"neg_{t.name}", later(unary.neg, x, t, then=_plus_zero(t)), f"-{x} + cast(0 AS {t.sql})"),
            _row(f"recip_{t.name}", later(unary.recip, x, t), f"cast(1 AS {q.sql}) / cast({x} AS {q.sql})"),
        ]
    return out


def _casts() -> list[Entry]:
    out = []
    for a, b in cast.PAIRS:
        n = _n(a)
        sql = f"cast(CASE WHEN isnan({n}) THEN 0 ELSE cast(trunc({n}) AS {b.sql}) END AS {b.sql})" if a.is_float and b.is_int else f"cast({n} AS {b.sql})"
        out.append(_row(f"cast_{a.name}_to_{b.name}", later(cast.cast, n, a, b), sql))
    return out


def _clips() -> list[Entry]:
    out = []
    for t, b in clip.PAIRS:
        x, lo, hi = f"cast({_n(t)} AS {b.sql})", LO[t], HI[t]
        keep = f"{x} IS NULL" + (f" OR isnan({x})" if b.is_float else "")
        out.append(_row(f"clip_{t.name}_{b.name}bounds", later(clip.clip, _n(t), lo, hi, t, b), f"CASE WHEN {keep} THEN {x} ELSE least(greatest({x}, {_lit(lo, b)}), {_lit(hi, b)}) END"))
    return out


def _reductions() -> list[Entry]:
    out = []
    for t in NUMERIC:
        # the plain forms read a column without NULL; the _valid forms skip it
        for form, n in (("", Ref(f"CASE WHEN {_n(t)} IS NULL THEN x{t.name} ELSE {_n(t)} END")), ("_valid", _n(t))):
            known = f"CASE WHEN NOT isnan({n}) THEN {n} END" if t.is_float else n
            low, high = (later(agg.min_, n, t), f"min({known})"), (later(agg.max_, n, t), f"max({known})")
            wide = (I64 if t.is_int else F64).sql
            text = f"cast(coalesce(sum({known}), 0) AS {wide})"
            total = (later(agg.sum_, n, t, then=_rounded(2)), f"round({text}, 2)") if t.is_float else (later(agg.sum_, n, t), text)
            out += [_agg(f"max_{t.name}{form}", result=high), _agg(f"min_{t.name}{form}", result=low), _agg(f"min_max_{t.name}{form}", low=low, high=high), _agg(f"sum_{t.name}{form}", result=total)]
    return out


def _dates() -> list[Entry]:
    d = Ref("dt")
    return [
        *(_row(f"extract_{p}", later(getattr(dates, f"extract_{p}"), d), f"cast({f}(dt) AS int)") for p, f in (("year", "year"), ("month", "month"), ("day", "day"), ("day_of_week", "dayofweek"))),
        *(_row(f"truncate_{p}", later(getattr(dates, f"truncate_{p}"), d), f"cast(date_trunc('{p}', dt) AS date)") for p in ("year", "month")),
        _row("date_diff", later(dates.diff, d, Ref("dt2")), "cast(datediff('day', dt2, dt) AS int)"),
    ]


def _statistics() -> list[Entry]:
    out = []
    for t in NUMERIC:
        n, wide = _n(t), (I64 if t.is_int else F64).sql
        known = f"CASE WHEN NOT isnan({n}) THEN {n} END" if t.is_float else n
        sums = f"cast(coalesce(sum({known}), 0) AS {wide})"
        out += [
            _agg(f"stat_max_{t.name}", result=(later(stats.stat_max, n, t), f"cast(max({known}) AS {wide})")),
            _agg(f"stat_min_{t.name}", result=(later(stats.stat_min, n, t), f"cast(min({known}) AS {wide})")),
            _agg(f"stat_sum_{t.name}", result=(later(stats.stat_sum, n, t, then=_rounded(2)), f"round({sums}, 2)") if t.is_float else (later(stats.stat_sum, n, t), sums)),
            _agg(f"stat_mean_{t.name}", result=(later(stats.mean, n, t, then=_rounded(6)), f"round(avg({known}), 6)")),
            _agg(f"stat_stddev_{t.name}", sample=(later(stats.stddev, n, t, then=_rounded(6)), f"round(stddev_samp({known}), 6)"), population=(later(stats.stddev, n, t, population=True, then=_rounded(6)), f"round(stddev_pop({known}), 6)")),
            _agg(f"stat_uniq_{t.name}", result=(later(stats.uniq, n, t), f"count(DISTINCT {known})")),
            _agg(f"count_{t.name}", result=(later(stats.count, n, t), f"count({known})")),
        ]
    both = "NOT isnan(nf64) AND nf64 IS NOT NULL AND yf64 IS NOT NULL"
    out.append(_agg("wtdmean", result=(later(stats.wtdmean, Ref("nf64"), Ref("yf64"), F64, F64, then=_rounded(6)), f"round(sum(yf64 * nf64) FILTER (WHERE {both}) / sum(yf64) FILTER (WHERE {both}), 6)")))

    def lengths(spark: SparkSession, folder: str) -> DataFrame:
        s = F.col("p_name")
        return read(spark, folder, "part").agg(stats.maxlen(s).alias("maxlen"), stats.minlen(s).alias("minlen"), stats.isascii(s).alias("isascii"))

    out.append(Entry("stat_strings", lengths, "SELECT cast(max(strlen(p_name)) AS bigint) AS maxlen, cast(min(strlen(p_name)) AS bigint) AS minlen, bool_and(length(p_name) = strlen(p_name)) AS isascii FROM part"))
    out.append(Entry("stat_issorted", lambda spark, folder: stats.is_sorted(read(spark, folder, "orders"), "o_custkey", "o_orderkey"), "SELECT bool_and(coalesce(p <= o_custkey, true)) AS sorted FROM (SELECT o_custkey, lag(o_custkey) OVER (ORDER BY o_orderkey) AS p FROM orders)"))
    return out


def _vectors() -> list[Entry]:
    out = []
    for t in NUMERIC:
        a, b = _n(t), _y(t)
        known = f"NOT isnan({a}) AND NOT isnan({b}) AND " if t.is_float else ""
        for op, sign in (("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<="), ("eq", "=")):
            out.append(_row(f"{op}_{t.name}_vec", later(getattr(compare, op), a, b, t), f"({known}{a} {sign} {b})"))
        out.append(_row(f"neq_{t.name}_vec", later(compare.neq, a, b, t), f"({a} <> {b}" + (f" OR isnan({a}) OR isnan({b}))" if t.is_float else ")")))
        lo, hi = Ref(f"x{t.name}"), _y(t)
        known = f"NOT isnan({a}) AND " if t.is_float else ""
        out.append(_row(f"bet_{t.name}_vec", later(compare.bet, a, lo, hi, t), f"({known}{a} >= {lo} AND {a} <= {hi})"))
        out.append(_row(f"nbet_{t.name}_vec", later(compare.nbet, a, lo, hi, t), f"({known}({a} < {lo} OR {a} > {hi}))"))
    out.append(_row("round_f64", later(unary.round_, Ref("yf64 * 25"), F64, then=_plus_zero(F64)), "round_even(yf64 * 25, 0) + 0.0"))
    out.append(_row("round_f32", later(unary.round_, Ref("xf32"), F32, then=_plus_zero(F32)), "cast(round_even(xf32, 0) + 0.0 AS float)"))
    return out


#: A date column with NULL, in both engines' SQL.
NULL_DATE = Ref("CASE WHEN k2 = 3 THEN NULL ELSE dt END")


def _calendar() -> list[Entry]:
    """Kernels of 32-bit integers on dates, which are days."""
    d, day = NULL_DATE, lambda iso: datetime.date.fromisoformat(iso)
    lit, lo, hi = "1998-03-01", "1996-02-29", "1999-12-31"
    out = [
        _row("date_add_lit", later(arith.add, d, 31, DATE), f"cast({d} + 31 AS date)"),
        _row("date_add_vec", later(arith.add, d, Ref("yi32"), DATE), f"cast({d} + yi32 AS date)"),
        _row("date_sub_lit", later(arith.sub, d, 31, DATE), f"cast({d} - 31 AS date)"),
        _row("date_sub_vec", later(arith.sub, d, Ref("yi32"), DATE), f"cast({d} - yi32 AS date)"),
    ]
    for op, sign in (("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<="), ("eq", "="), ("neq", "<>")):
        out.append(_row(f"{op}_date", later(getattr(compare, op), d, day(lit), DATE), f"({d} {sign} DATE '{lit}')"))
        out.append(_row(f"{op}_date_vec", later(getattr(compare, op), d, Ref("dt2"), DATE), f"({d} {sign} dt2)"))
    out.append(_row("bet_date", later(compare.bet, d, day(lo), day(hi), DATE), f"({d} BETWEEN DATE '{lo}' AND DATE '{hi}')"))
    out.append(_row("nbet_date", later(compare.nbet, d, lo, hi, DATE), f"({d} NOT BETWEEN DATE '{lo}' AND DATE '{hi}')"))
    for form, x in (("", Ref("dt")), ("_valid", d)):
        low, high = (later(agg.min_, x, DATE), f"min({x})"), (later(agg.max_, x, DATE), f"max({x})")
        out += [_agg(f"max_date{form}", result=high), _agg(f"min_date{form}", result=low), _agg(f"min_max_date{form}", low=low, high=high)]
    return out


def _nulls_and_bytes() -> list[Entry]:
    """Tests for NULL (NaN is none), masks of selected rows, and masks packed in integers."""
    out = []
    for name, x in (("i64", _n(I64)), ("f64", _n(F64)), ("date", NULL_DATE)):
        out += [
            _row(f"is_na_{name}", later(masks.is_na, x), f"({x} IS NULL)"),
            _row(f"not_na_{name}", later(masks.not_na, x), f"({x} IS NOT NULL)"),
            _row(f"is_na_binary_{name}", later(masks.is_na_binary, x), f"cast({x} IS NULL AS tinyint)"),
            _row(f"not_na_binary_{name}", later(masks.not_na_binary, x), f"cast({x} IS NOT NULL AS tinyint)"),
        ]
    a, b = Ref("xi32 * 37 & 255"), Ref("yi32 & 255")
    out += [
        _row("mask_and", later(masks.both, Ref("m1"), Ref("m2")), "(m1 AND m2)"),
        _row("mask_or", later(masks.either, Ref("m1"), Ref("m2")), "(m1 OR m2)"),
        _row("byte_and", later(masks.byte_and, a, b), f"(({a}) & ({b}))"),
        _row("byte_or", later(masks.byte_or, a, b), f"(({a}) | ({b}))"),
        _agg("byte_and_popcount", result=(later(masks.byte_and_count, a, b, then=_summed), f"cast(sum(bit_count(({a}) & ({b}))) AS bigint)")),
        _agg("byte_or_popcount", result=(later(masks.byte_or_count, a, b, then=_summed), f"cast(sum(bit_count(({a}) | ({b}))) AS bigint)")),
    ]
    kinds = ((STR, Ref("CASE WHEN k2 <> 3 THEN s1 END")), (DATE, NULL_DATE), (BOOL, Ref("CASE WHEN k2 <> 3 THEN m1 END")))
    for t, x in kinds:
        out += [_agg(f"stat_uniq_{t.name}", result=(later(stats.uniq, x, t), f"count(DISTINCT {x})")), _agg(f"count_{t.name}", result=(later(stats.count, x, t), f"count({x})"))]
    for tx, tw, x, w in ((I32, F32, "ni32", "xf32"), (I64, I32, "ni64", "yi32"), (F32, I64, "nf32", "yi64")):
        known = f"{x} IS NOT NULL" + (f" AND NOT isnan({x})" if tx.is_float else "")
        total = f"sum(cast({w} AS double) * cast({x} AS double)) FILTER (WHERE {known}) / sum(cast({w} AS double)) FILTER (WHERE {known})"
        out.append(_agg(f"wtdmean_{tx.name}_{tw.name}", result=(later(stats.wtdmean, Ref(x), Ref(w), tx, tw, then=_rounded(6)), f"round({total}, 6)")))
    days = lambda spark, folder: read(spark, folder, "orders").selectExpr("o_orderkey", "cast(o_orderdate AS date) AS day")
    sql = "SELECT coalesce(bool_and(coalesce(p <= day, true)), true) AS sorted FROM (SELECT day, lag(day) OVER (ORDER BY {}, day) AS p FROM (SELECT o_orderkey, cast(o_orderdate AS date) AS day FROM orders))"
    out.append(Entry("stat_issorted_date", lambda spark, folder: stats.is_sorted(days(spark, folder), "day", "o_orderkey"), sql.format("o_orderkey")))
    ascending = lambda spark, folder: read(spark, folder, "orders").selectExpr("o_orderkey", "cast(o_orderkey * 2 AS double) AS twice")
    out.append(Entry("stat_issorted_f64", lambda spark, folder: stats.is_sorted(ascending(spark, folder), "twice", "o_orderkey"), "SELECT bool_and(coalesce(p <= twice, true)) AS sorted FROM (SELECT twice, lag(twice) OVER (ORDER BY o_orderkey, twice) AS p FROM (SELECT o_orderkey, cast(o_orderkey * 2 AS double) AS twice FROM orders))"))
    return out


def _text() -> list[Entry]:
    s, wide = Ref("p_name"), Ref("'  ' || p_name || ' '")
    table: dict[str, tuple[Callable[[], Column], str]] = {
        "concat": (later(strings.concat, s, Ref("p_brand")), "p_name || p_brand"),
        "to_upper": (later(strings.to_upper, s), "upper(p_name)"),
        "to_lower": (later(strings.to_lower, s), "lower(p_name)"),
        "to_title": (later(strings.to_title, s), "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"),
        "replace": (later(strings.replace, s, "a", "bb"), "replace(p_name, 'a', 'bb')"),
        "strip": (later(strings.strip, wide), f"trim({wide})"),
        "strip_left": (later(strings.strip_left, wide), f"ltrim({wide})"),
        "strip_right": (later(strings.strip_right, wide), f"rtrim({wide})"),
        "str_len": (later(strings.str_len, s), "cast(length(p_name) AS int)"),
        "str_eq": (later(strings.eq, Ref("p_brand"), "Brand#11"), "p_brand = 'Brand#11'"),
        "str_contains": (later(strings.contains, s, "1"), "contains(p_name, '1')"),
    }

    def entry(name: str, column: Callable[[], Column], sql: str) -> Entry:
        return Entry(name, lambda spark, folder: read(spark, folder, "part").select("p_partkey", column().alias("result")), f"SELECT p_partkey, {sql} AS result FROM part")

    return [entry(k, c, q) for k, (c, q) in table.items()]


def selective_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Two predicates, the count of rows that pass both, and reductions over those rows, in one pass."""
    with wrapping(spark):
        rows = read(spark, folder, "lineitem").where(compare.gt(F.col("l_quantity"), 25.0, F64) & compare.bet(F.col("l_discount"), 0.02, 0.06, F64))
        x = F.col("l_extendedprice")
        return rows.agg(F.count(F.lit(1)).alias("selected"), F.round(agg.sum_(x, F64), 2).alias("total"), agg.min_(x, F64).alias("low"), agg.max_(x, F64).alias("high"))


SELECTIVE_SQL = "SELECT count(*) AS selected, round(sum(l_extendedprice), 2) AS total, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem WHERE l_quantity > 25 AND l_discount BETWEEN 0.02 AND 0.06"


def grouped(spark: SparkSession, folder: str) -> DataFrame:
    """The reductions under groupBy: partial sums before the one small exchange."""
    with wrapping(spark):
        return read(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(*(F.round(agg.sum_(F.col(c), F64), 2).alias(f"sum_{c}") for c in ("l_quantity", "l_extendedprice")), agg.max_(F.col("l_tax"), F64).alias("max_tax"), F.count(F.lit(1)).alias("n"))


GROUPED_SQL = "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_l_quantity, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, max(l_tax) AS max_tax, count(*) AS n FROM lineitem GROUP BY ALL"


def kernels() -> list[Entry]:
    """The base inventory: 146 kernels (and the date difference)."""
    return [*_masks(), *_broadcasts(), *_filters(), *_arithmetic(), *_unary(), *_casts(), *_clips(), *_reductions(), *_dates()]


def entries() -> dict[str, Entry]:
    more = [*_statistics(), *_vectors(), *_calendar(), *_nulls_and_bytes(), *_text(), Entry("selective_sum", selective_sum, SELECTIVE_SQL), Entry("grouped", grouped, GROUPED_SQL)]
    return {e.name: e for e in [*kernels(), *more]}
