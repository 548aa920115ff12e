"""Shared folder, written tables, settings for a while and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side is broadcast only if a count has shown it to hold at most so many rows of a few numbers each.
BROADCAST_ROWS = 200_000
#: What an operator keeps in a worker from task to task.
lasting: list = []
#: Folders of our own, by application, where a local session names none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session without one gets a temporary one; elsewhere that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="colonnade-")
        where = _own[context.applicationId]
    return f"{where.rstrip('/')}/colonnade-{spark.sparkContext.applicationId}"


@contextmanager
def setting(spark: SparkSession, **values: object) -> Iterator[None]:
    """Session settings for a while; double underscores in a name stand for dots."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 250, size: str = "8m"):
    """Whole texts go to Python by so many rows and bytes at most, meanwhile: a batch is held on both sides, several times over.

    An executor keeps room of the size of the largest batches, outside its heap and in each of many threads.
    """
    return setting(spark, spark__sql__execution__arrow__maxRecordsPerBatch=rows, spark__sql__execution__arrow__maxBytesPerBatch=size)


def released() -> None:
    """Gives back to the system what this process has freed and what other operators kept: the driver, or a worker that ran them before, has it otherwise."""
    lasting.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few of their texts are Python strings at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and lost executors lose nothing. Its shuffle files go when it is written."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with setting(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def place(df: DataFrame | None) -> str | None:
    """Where `written` made df. A column of that name is no place."""
    return vars(df).get("written_to") if df is not None else None


def removed(*dfs: DataFrame | None) -> None:
    """Deletes tables that `written` made and nothing reads any more."""
    for df in dfs:
        if path := place(df):
            _delete(df.sparkSession, path)


def swept(spark: SparkSession) -> None:
    """Deletes all tables that `written` made in this application; results that were not stored are lost."""
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each of names, with underscores added until df has no such column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{n}.parquet") for n in names]


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `rows` rows, so that it may be broadcast; Spark joins by shuffle otherwise."""
    return df.limit(rows + 1).count() <= rows


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node reachable.

    Large-star and small-star by turns until the edges are stars; each round is a
    written table, and that of the round before is deleted. Minima are aggregated
    before they are shuffled.
    """
    pairs = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = written(pairs(edges), "edges"), None
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = pairs(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m").union(low.select("a", "m")).toDF("a", "b")
        last, now = now, written(pairs(small), "edges")
        removed(last)
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).head()
        if state == before:
            return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(now.select("b", "b").distinct())
        before = state
    raise RuntimeError("components did not settle")
