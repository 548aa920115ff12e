"""Column statistics. All skip NULL and NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colonnade.operators import agg
from colonnade.semantics import not_nan
from colonnade.types import F64, I64, NUMERIC, STR, Logical, column_type, require


def _wide(x: Column, t: Logical) -> Column:
    return x.cast((I64 if t.is_int else F64).spark)


def stat_max(x: Column, t: Logical) -> Column:
    return _wide(agg.max_(x, t), t)


def stat_min(x: Column, t: Logical) -> Column:
    return _wide(agg.min_(x, t), t)


def stat_sum(x: Column, t: Logical) -> Column:
    return agg.sum_(x, t)


def count(x: Column, t: Logical) -> Column:
    return F.count(not_nan(x, t))


def mean(x: Column, t: Logical) -> Column:
    require(t, *NUMERIC)
    return F.avg(not_nan(x, t))


def stddev(x: Column, t: Logical, population: bool = False) -> Column:
    """Sample deviation by default."""
    require(t, *NUMERIC)
    return (F.stddev_pop if population else F.stddev_samp)(not_nan(x, t))


def wtdmean(x: Column, w: Column, t: Logical, tw: Logical) -> Column:
    """sum(w x) / sum(w) over rows where both are known; NULL if the weights sum to 0."""
    both = not_nan(x, t).isNotNull() & not_nan(w, tw).isNotNull()
    total = F.sum(F.when(both, w.cast("double")))
    return F.when(total != 0, F.sum(F.when(both, w.cast("double") * x.cast("double"))) / total)


def uniq(x: Column, t: Logical, approximate: bool = False) -> Column:
    return (F.approx_count_distinct if approximate else F.countDistinct)(not_nan(x, t))


def maxlen(s: Column) -> Column:
    return F.max(F.octet_length(s)).cast("bigint")


def minlen(s: Column) -> Column:
    return F.min(F.octet_length(s)).cast("bigint")


def isascii(s: Column) -> Column:
    return F.bool_and(F.char_length(s) == F.octet_length(s))


def is_sorted(df: DataFrame, x: str, *keys: str, buckets: int = 64) -> DataFrame:
    """One row, `sorted`: whether x ascends in the order of `keys`; NULL and NaN are skipped.

    Rows with equal keys count in the order of x, so they are never out of order among
    themselves. The rows are cut into ranges of the first key (a number), whose bounds one
    action finds when the frame is built; each range is checked alone, and the ranges'
    ends are then compared, so no task holds all rows. An empty frame is sorted.
    """
    t = column_type(df, x)
    cuts = df.select(F.percentile_approx(F.col(keys[0]), [i / buckets for i in range(1, buckets)], 10_000)).head()[0] or []
    bucket = F.lit(0)
    for c in sorted(set(cuts)):
        bucket = bucket + (F.col(keys[0]) > F.lit(c)).cast("int")
    rows = df.where(not_nan(F.col(x), t).isNotNull()).select(bucket.alias("_b"), F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(x).alias("x")).alias("_k"), F.col(x).alias("_x"))
    inner = rows.withColumn("_p", F.lag("_x").over(Window.partitionBy("_b").orderBy("_k")))
    ends = inner.groupBy("_b").agg(F.bool_and(F.coalesce(F.col("_p") <= F.col("_x"), F.lit(True))).alias("_ok"), F.min_by("_x", "_k").alias("_first"), F.max_by("_x", "_k").alias("_last"))
    # a row for each range, at most `buckets`
    linked = ends.withColumn("_p", F.lag("_last").over(Window.orderBy("_b")))
    return linked.agg(F.coalesce(F.bool_and(F.col("_ok") & F.coalesce(F.col("_p") <= F.col("_first"), F.lit(True))), F.lit(True)).alias("sorted"))


def describe(df: DataFrame, *names: str) -> DataFrame:
    """Every statistic of the named columns in one pass: a row with `<column>_<stat>` columns."""
    out = []
    for n in names:
        x, t = F.col(n), column_type(df, n)
        if t == STR:
            out += [maxlen(x).alias(f"{n}_maxlen"), minlen(x).alias(f"{n}_minlen"), isascii(x).alias(f"{n}_isascii")]
        elif t.is_numeric:
            out += [stat_max(x, t).alias(f"{n}_max"), stat_min(x, t).alias(f"{n}_min"), stat_sum(x, t).alias(f"{n}_sum"), mean(x, t).alias(f"{n}_mean"), stddev(x, t).alias(f"{n}_stddev")]
        out += [count(x, t).alias(f"{n}_count"), uniq(x, t, approximate=True).alias(f"{n}_uniq")]
    return df.agg(*out)
