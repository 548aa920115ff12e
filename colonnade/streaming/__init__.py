"""Elementwise kernels and reductions on unbounded inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(stream: DataFrame, time: str, every: str, late: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """Tumbling windows of the reductions in `operators.agg`, with a bound on lateness.

    Rows later than `late` behind the newest one are left out by the watermark.
    """
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, every).alias("window"), *keys)
        .agg(*(c.alias(k) for k, c in aggregates.items()))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggregates)
    )
