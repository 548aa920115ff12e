"""The Parquet tables of a data folder. Any path that Spark can open will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def register(spark: SparkSession, folder: str, *tables: str) -> None:
    """Temp views of the tables (all by default) for spark.sql."""
    for t in tables or TABLES:
        read(spark, folder, t).createOrReplaceTempView(t)
