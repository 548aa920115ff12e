"""Document fingerprints by one-permutation MinHash, in DataFrame operations only.

Shingles of five words (lower-cased, split at white space; all words if they are fewer)
are hashed once. The top bits of a hash choose one of 128 bins, which keeps its least
hash. An empty bin takes the value of a filled one, by an independent choice for every
empty bin (that with the least hash of the two numbers), which is optimal densification.
A bin keeps the 8 low bits. Two unlike bins agree by chance once in 256, for which the
likeness is corrected.

A null text is as an empty one; texts without a word are alike. The next document is
that with the next smaller doc_id, after the last the first; equal doc_ids are ordered by
the hash of their texts, and null doc_ids come after all others. A table of one row is
followed by itself. Very long texts are fingerprinted whole, as an array of their hashes
in one row. Rows with one doc_id lie in one range, so a table whose doc_ids are largely
the same has a long range. Repeated rows give a row each; an empty table gives an empty
table. Other columns are passed over, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from colonnade.llm.common import tables

SHINGLE, BINS, BITS = 5, 128, 8
#: Bytes of text in a range of doc_ids, which is a task's.
RANGE = 1 << 24
_BIN = 64 - (BINS.bit_length() - 1)
_MASK = (1 << BITS) - 1


def fingerprinted(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with the fingerprint of a text column: an array of BINS numbers of BITS bits."""
    keep = [f"`{c}`" for c in df.columns]
    hashed = ", ".join(f"_w[i + {j}]" for j in range(SHINGLE))
    words = f"transform(filter(split(lower(coalesce(`{text}`, '')), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''), w -> xxhash64(w))"
    df = df.selectExpr(*keep, f"{words} AS _w")
    df = df.selectExpr(*keep, f"sort_array(IF(size(_w) >= {SHINGLE}, transform(sequence(0, greatest(size(_w) - {SHINGLE}, 0)), i -> xxhash64({hashed})), array(xxhash64(_w)))) AS _h")
    # sorted hashes hold each bin's in a row, the least first
    df = df.selectExpr(*keep, f"filter(_h, (x, i) -> i = 0 OR shiftrightunsigned(x, {_BIN}) <> shiftrightunsigned(_h[greatest(i - 1, 0)], {_BIN})) AS _m")
    df = df.selectExpr(*keep, "_m", f"transform(_m, x -> cast(shiftrightunsigned(x, {_BIN}) AS int)) AS _b")
    low = f"cast(x & {_MASK} AS int)"
    other = f"cast(array_min(transform(_m, (x, i) -> (xxhash64(b, _b[i]) & {~_MASK}) | (x & {_MASK}))) & {_MASK} AS int)"
    # if all bins are filled, they are in signed order
    full = f"transform(sequence(0, {BINS - 1}), b -> cast(_m[(b + {BINS // 2}) % {BINS}] & {_MASK} AS int))"
    some = f"transform(sequence(0, {BINS - 1}), b -> IF(array_contains(_b, b), cast(_m[cast(array_position(_b, b) AS int) - 1] & {_MASK} AS int), {other}))"
    return df.selectExpr(*keep, f"IF(size(_m) = {BINS}, {full}, {some}) AS `{to}`")


def packed(prints: str) -> Column:
    """The bits of a fingerprint as hexadecimal digits."""
    return F.array_join(F.transform(prints, lambda v: F.lower(F.lpad(F.hex(v), BITS // 4, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Estimated share of common shingles, 0 to 1."""
    chance = 1 / (1 << BITS)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    return F.greatest(F.lit(0.0), (same - F.lit(chance)) / F.lit(1 - chance))


def ranged(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (doc_id) with place, a doc_id that is never null, and bucket: that of the highest places is 0.

    The cuts are looked up in two steps, in about the square root of their number.
    """
    docs = docs.withColumn("place", F.coalesce("doc_id", F.lit(-(2**63))))
    cuts = docs.select(F.percentile_approx("place", [i / buckets for i in range(1, buckets)], max(10_000, 20 * buckets))).head()[0] if buckets > 1 else None
    cuts = sorted(set(cuts or []), reverse=True)
    if not cuts:
        return docs.withColumn("bucket", F.lit(0))
    step = max(1, round(len(cuts) ** 0.5))
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    longs = lambda v: "array(" + ", ".join(f"{c}L" for c in v) + ")"
    part = f"size(filter({longs([p[-1] for p in parts])}, c -> c > place))"
    docs = docs.withColumn("part", F.expr(part))
    # the last part may have fewer cuts
    return docs.withColumn("bucket", F.expr(f"least({len(cuts)}, part * {step} + coalesce(size(filter(get(array({', '.join(map(longs, parts))}), part), c -> c > place)), 0))")).drop("part")


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, text, print, next_text, next_print) of docs (doc_id, digest, text): each and the one that follows by descending doc_id.

    doc_id is cut into ranges with a task each. To each range the first document of the
    range below, found by its id alone, is added as its end.
    """
    docs = ranged(docs, buckets)
    # a row for each range, `buckets` at most; only doc_id is read for it
    heads = docs.groupBy("bucket").agg(F.max("place").alias("place"))
    line = Window.orderBy("bucket")
    heads = heads.select("place", F.coalesce(F.lag("bucket").over(line), F.max("bucket").over(Window.partitionBy())).alias("above"))
    # of documents with the same doc_id the one that comes first
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "digest")
    ends = docs.select("doc_id", "place", "text", "digest").join(F.broadcast(heads), "place").groupBy(F.col("above").alias("bucket")).agg(F.min_by("text", first).alias("text"))
    rows = docs.withColumn("is_end", F.lit(False)).unionByName(ends.withColumn("is_end", F.lit(True)), allowMissingColumns=True)
    # by hash several ranges would meet in one task, and others would have none
    rows = fingerprinted(rows.repartitionById(buckets, "bucket"), "text", "print")
    w = Window.partitionBy("bucket").orderBy("is_end", F.col("place").desc(), F.col("doc_id").desc_nulls_last(), F.col("digest"))
    carried = ["text", "print"]
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).where(~F.col("is_end"))
    return rows.select("doc_id", *carried, *(f"next_{c}" for c in carried))


def range_count(docs: DataFrame) -> int:
    """Ranges of about `RANGE` bytes of text, and as many as a shuffle has partitions at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    (docs,) = tables(spark, folder, "documents")
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(docs.withColumn("digest", F.md5(F.col("text").cast("binary"))), range_count(docs)).withColumn("n_chars", F.char_length("text").cast("bigint"))
    k = F.floor(F.col("n_chars") / 3).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - k), F.substring("next_text", F.lit(1), k)))
    df = df.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "print", F.col("next_print").alias("following"), "edited")
    df = fingerprinted(df, "edited", "edited_print")
    return df.select("doc_id", "n_chars", "edited_sha256", packed("print").alias("fingerprint"), packed("edited_print").alias("edited_fingerprint"), likeness("print", "edited_print").alias("near_edited"), likeness("print", "following").alias("near_next"))
