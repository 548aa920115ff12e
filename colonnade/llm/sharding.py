"""Byte-balanced sharding by Karmarkar-Karp differencing.

Documents with equal texts stay together, as a group. A partial partition is a tuple of
shard sizes; the two with the largest spread are combined, the larger shards of one with
the smaller of the other, until one is left.

It runs in levels, so that no task holds all groups. Parts are, first, the groups; on
each level they fall into hash buckets of about `BATCH` parts at most, and each bucket is
differenced into `shards` pieces, which are the parts of the next level, until `FINAL` are left.
Those are differenced in one place with what was held back: the groups above
1/`HEAVY` of a shard's share, of which there are `HEAVY` times the shards at most, and a
share of all groups, `FINAL` in expectation, whose small sizes even out the rest. The
levels follow from the number of groups alone, and a table with fewer groups than `FINAL`
is differenced directly.

A null text is as an empty one. Rows that repeat a doc_id, or have none, are placed one
by one. A group larger than a shard's share makes its shard larger than the rest; no other
law could keep it whole. Of equal sizes the one with the least text digest goes first.
Only lengths of very long texts leave the scan. Other columns are passed over, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from colonnade.llm.common import tables, written

SHARDS, BATCH, FINAL, HEAVY = 24, 20_000, 16_384, 64
#: Rows of a shard that are numbered in one task.
NUMBERED = 20_000


def _combine(parts: list[tuple[list[int], list]], shards: int) -> tuple[list[int], list]:
    """parts: (sizes in descending order, their contents). Contents are leaves, None or pairs."""
    heap = [(s[-1] - s[0], i, s, c) for i, (s, c) in enumerate(parts)]
    heapq.heapify(heap)
    at = len(parts)
    while len(heap) > 1:
        _, _, s, c = heapq.heappop(heap)
        _, _, t, d = heapq.heappop(heap)
        sizes = [a + b for a, b in zip(s, reversed(t))]
        order = sorted(range(shards), key=sizes.__getitem__, reverse=True)
        both = [x if y is None else y if x is None else (x, y) for x, y in zip(c, reversed(d))]
        sizes = [sizes[k] for k in order]
        heapq.heappush(heap, (sizes[-1] - sizes[0], at, sizes, [both[k] for k in order]))
        at += 1
    return heap[0][2], heap[0][3]


def differencing(sizes: list[int], shards: int = SHARDS, batch: int = BATCH) -> list[int]:
    """The shard of each size."""
    if not sizes:
        return []
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    leaves = [([sizes[i]] + [0] * (shards - 1), [(i,)] + [None] * (shards - 1)) for i in order[:batch]]
    parts = []
    for k in range(0, len(order), batch):
        if k:
            leaves = [([sizes[i]] + [0] * (shards - 1), [(i,)] + [None] * (shards - 1)) for i in order[k : k + batch]]
        parts.append(_combine(leaves, shards))
    _, contents = _combine(parts, shards)
    out = [0] * len(sizes)
    for shard, tree in enumerate(contents):
        stack = [tree] if tree is not None else []
        while stack:
            x = stack.pop()
            if len(x) == 1:
                out[x[0]] = shard
            else:
                stack += x
    return out


def grouped(groups: DataFrame, shards: int, total: int, n_groups: int) -> DataFrame:
    """(digest, shard) of groups (digest, bytes)."""
    spark = groups.sparkSession
    heavy = F.col("bytes") > F.lit(max(1, total // (shards * HEAVY)))
    chance = F.shiftrightunsigned(F.xxhash64("digest", F.lit(1)), 11) / F.lit(2.0**53)
    held = heavy | (chance < F.lit(min(1.0, FINAL / max(1, n_groups))))
    # each level: (part, piece), where the parts of the first are digests
    levels: list[DataFrame] = []
    parts = groups.where(~held).select(F.col("digest").alias("part"), "bytes")
    n = parts.count()
    while n > (FINAL if levels else 0):
        # as many buckets, so as small pieces, as the last place can hold
        buckets = max(-(-n // BATCH), min(FINAL // shards, -(-n // (8 * shards))))

        def place(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["bytes", "part"], ascending=[False, True])
            found = differencing(pdf.bytes.tolist(), shards)
            return pd.DataFrame({"part": pdf.part, "piece": [f"{b}.{k}".encode() for b, k in zip(pdf.bucket, found)], "bytes": pdf.bytes})

        dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("part", F.lit(len(levels))), F.lit(buckets)).cast("int"))
        levels.append(written(dealt.groupBy("bucket").applyInPandas(place, "part binary, piece binary, bytes bigint"), "pieces"))
        parts = written(levels[-1].groupBy("piece").agg(F.sum("bytes").alias("bytes")).withColumnRenamed("piece", "part"), "parts")
        n, before = parts.count(), n
        if n >= before:
            break
    # bounded: pieces, heavy groups, and those held back
    last = [(bytes(r["part"]), False, r["bytes"]) for r in parts.collect()] if levels else []
    last += [(bytes(r["digest"]), True, r["bytes"]) for r in groups.where(held).select("digest", "bytes").collect()]
    last.sort(key=lambda p: (-p[2], p[0]))
    found = differencing([p[2] for p in last], shards)
    where = spark.createDataFrame([(p, own, s) for (p, own, _), s in zip(last, found)], "part binary, own boolean, shard int")
    own = where.where("own").select(F.col("part").alias("digest"), "shard")
    if not levels:
        return own
    # `FINAL` pieces or so, and buckets * shards on each level below
    place_of = where.where("NOT own").select(F.col("part").alias("piece"), "shard")
    for level in reversed(levels[1:]):
        place_of = level.join(place_of, "piece").select(F.col("part").alias("piece"), "shard")
    return levels[0].join(place_of, "piece").select(F.col("part").alias("digest"), "shard").union(own)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slots of a shard are numbered from 0."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    base = written(docs.select(F.col("doc_id").cast("bigint"), (F.octet_length(raw) + F.lit(8)).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.md5(raw)).alias("digest")), "sizes")
    groups = written(base.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    n_groups, total, n_rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).head()
    where = grouped(groups, shards, total, n_groups)

    parts = max(8, -(-n_rows // (shards * NUMBERED)))
    rows = base.join(where, "digest").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int").alias("part"))
    # a row for each shard and part
    starts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("shard").orderBy("part")
    starts = starts.select("shard", "part", (F.sum("n").over(w) - F.col("n")).alias("first"))
    w = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("i", F.row_number().over(w)).join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("i") - 1).alias("slot"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    out = sharded(*tables(spark, folder, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
