"""SimHash near-duplicates by multi-index hashing.

A fingerprint's bit is set if it is set in over half of the hashes of the document's
shingles. Two uses:

* `linked`: documents whose 64-bit fingerprints differ in at most two bits, closed
  transitively. The fingerprint is cut into two halves. Two fingerprints that differ
  in two bits at most agree in the low half, or differ in one bit of the high half at
  most, so probing each high half's ball of radius one and the low half itself meets
  every link; complete distances are then verified. Copies of a fingerprint are one
  row from the start. A table bucket with more than `CROWD` fingerprints is not
  paired: those fingerprints spell out their whole 64-bit balls of radius one, where
  all that meet are within two bits of each other, and join the least of each ball.
* `similar`: documents of whose distinct shingles of five words 0.8 or more are
  shared. Candidates are those whose fingerprints of distinct shingles link as above.
  Fingerprints miss some pairs, so the first fifth of each document's shingles in one
  order of all shingles, in which any two such documents share one, gives the rest. All
  candidates are verified exactly. Pairs that are already in one class are left out.

Null and empty texts have fingerprint zero. Repeated rows give repeated rows. Columns
other than doc_id and text are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from colonnade.llm.common import components, fits, released, removed, small_batches, tables, written

WORDS, SEED, CROWD = 3, 42, 64
#: Shingles in OFTEN or more of one in SAMPLED texts come last in the order of shingles, COMMON of them at most.
SAMPLED, OFTEN, COMMON = 16, 4, 200_000
#: Bits of a shingle's hash by which shingles are counted, to bound what two sets share.
BIN_BITS = 8
#: Nodes whose rows are found by a table sent to every task, of 16 bytes a node; more of them meet their rows in a shuffle.
HELD = 500_000
#: Nodes of a bucket that are compared by pairs in one place.
BLOCK = 256
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are unpacked at a time.
STEP = 1 << 15


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Unsigned XXH64 of each run of `words` words, repeats included; of all words if they are fewer."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    line, h = b" ".join(w), xxhash.xxh64_intdigest
    at = [0]
    for x in w:
        at.append(at[-1] + len(x) + 1)
    return np.array([h(line[a : b - 1], SEED) for a, b in zip(at, at[words:])], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """Signed 64-bit fingerprint of shingle hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), STEP):
        bits = np.unpackbits(h[i : i + STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f): the fingerprint of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(shingle_hashes(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, f bigint")


HIGH, LOW = "shiftrightunsigned(f, 32)", "(f & 4294967295) | 4294967296"


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct fingerprints f that link, enough of them to reach all that are linked."""
    table = prints.select("f", F.explode(F.expr(f"array({HIGH}, {LOW})")).alias("key"))
    # a pair that differs in one bit meets where the one that has it clears it
    ball = f"concat(array({HIGH}, {LOW}), transform(filter(sequence(0, 31), i -> (shiftright({HIGH}, i) & 1) = 1), i -> {HIGH} ^ shiftleft(1L, i)))"
    probes = prints.select("f", F.explode(F.expr(ball)).alias("key"))
    sizes = table.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    crowded = written(sizes.where(F.col("n") > CROWD).select("key"), "crowded")
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    if crowded.isEmpty():
        rows, rest = table, None
    else:
        rows = table.join(crowded, "key", "left_anti")
        rest = probes.join(crowded, "key", "left_semi").select("f").distinct()
    found = rows.select("key", F.col("f").alias("b")).join(probes.select("key", F.col("f").alias("a")), "key").where(F.col("a") != F.col("b")).where(within).select("a", "b")
    if rest is not None:
        whole = rest.select("f", F.explode(F.expr("concat(array(f), transform(sequence(0, 63), i -> f ^ shiftleft(1L, i)))")).alias("z"))
        least = whole.groupBy("z").agg(F.min("f").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        found = found.union(whole.join(least, "z").where("f <> b").select("f", "b"))
    return found.distinct()


def root_links(groups: DataFrame, node: str) -> DataFrame:
    """(a, b): the least nodes of linked fingerprints, of groups (f, node) with a row for each fingerprint."""
    links = fingerprint_links(groups.select("f"))
    roots = groups.select("f", node)
    return links.join(roots.toDF("a", "ra"), "a").join(roots.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id)."""
    with small_batches(docs.sparkSession):
        base = written(fingerprints(docs), "prints")
    groups = written(base.groupBy("f").agg(F.min("doc_id").alias("root")), "groups")
    found = components(root_links(groups, "root"))
    classes = groups.join(found, groups.root == found.node, "left").select("f", F.coalesce("component", "root").alias("component_id"))
    return base.join(classes, "f").select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def prefixes(docs: DataFrame, words: int, least: float, common: np.ndarray) -> DataFrame:
    """(doc_id, text_md5, digest, f, n, bins, keys): a row's own text, its distinct shingles, their fingerprint, their number, how many have each first byte, and the first of them.

    All shingles are in one order: those that are not in `common` (sorted) before those
    that are, then by hash. Two sets that share `least` of their union share one of the
    first n - ceil(least * n) + 1 in that order, whatever the order is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for b in batches:
            digests, marks, sizes, bins, keys = [], [], [], [], []
            for t in b.column(2).to_pylist():
                h = np.unique(shingle_hashes(t, words))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                marks.append(fingerprint(h))
                sizes.append(len(h))
                bins.append(np.bincount(h >> np.uint64(64 - BIN_BITS), minlength=1 << BIN_BITS).astype(np.int32))
                if len(common) and len(h):
                    late = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
                    h = np.concatenate([h[~late], h[late]])
                keys.append(h[: first_of(len(h), least)].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(marks, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bins, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))], names=names)

    names = ["doc_id", "text_md5", "digest", "f", "n", "bins", "keys"]
    return docs.select(F.col("doc_id").cast("bigint"), text_md5().alias("text_md5"), "text").mapInArrow(run, "doc_id bigint, text_md5 binary, digest binary, f bigint, n int, bins array<int>, keys array<bigint>")


def first_of(n: int, least: float) -> int:
    """How many shingles of n any set alike has one of; a little more where least * n is not exact."""
    return n - math.ceil(least * n - 1e-9) + 1 if n else 0


def text_md5() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts of a sample hold: `COMMON` at most, the most frequent. They only decide an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for b in batches:
            found = [np.unique(shingle_hashes(t, words)) for t in b.column(0).to_pylist()]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "h bigint, n bigint")
    with small_batches(docs.sparkSession):
        held = written(sample.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN), "common")
    # by quarter octaves of their counts: a few hundred rows
    bands = held.groupBy(F.floor(F.log2("n") * 4).alias("band")).agg(F.count(F.lit(1)).alias("shingles"), F.min("n").alias("least")).orderBy(F.desc("band")).collect()
    lowest, total = None, 0
    for r in bands:
        total += r["shingles"]
        if total > COMMON:
            break
        lowest = r["least"]
    if lowest is None:
        return np.zeros(0, np.uint64)
    return np.sort(held.where(F.col("n") >= lowest).select("h").toArrow().column("h").to_numpy().view(np.uint64))


def likes(pairs: DataFrame, docs: DataFrame, groups: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes of which `least` of all shingles are shared, written.

    Two sets share no more than the sum, over bins of hashes, of the lesser of their
    counts; whole texts are read again only for pairs which that allows.
    """
    bound = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    own = groups.select("node", "n", "bins")
    near = pairs.join(own.toDF("a", "na", "ba"), "a").join(own.toDF("b", "nb", "bb"), "b")
    pairs = written(near.where(bound >= F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - F.lit(1e-6)).select("a", "b"), "bounded")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    nodes = nodes.join(groups.select("node", "digest"), "node").join(rows, "digest").select("node", "row.doc_id", "row.text_md5")
    nodes = written(nodes, "nodes")
    with small_batches(docs.sparkSession):
        sets = written(shingle_sets(docs, nodes, words), "sets")
    shared = F.size(F.array_intersect("sa", "sb"))
    near = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    near = written(near.where(shared >= F.lit(least) * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "near")
    removed(pairs, nodes, sets)
    return near


def may_be_like(x: str, y: str, least: float) -> Column:
    """Whether sets (n, at) that share their shingles at those places can share `least`, if they share none before."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    # all others that they share come after it in both
    most = F.least(n - F.col(f"{x}.at"), m - F.col(f"{y}.at"))
    return (most >= F.lit(least / (1 + least)) * (n + m) - F.lit(1e-6)) & (F.least(n, m) >= F.lit(least) * F.greatest(n, m) - F.lit(1e-6))


def with_classes(met: DataFrame, links: DataFrame) -> DataFrame:
    """met (key, node, n, at) of the buckets where links leave more than one class, with the class of each node."""
    found = components(links)
    rows = met.join(found, "node", "left").select("key", "node", "n", "at", F.coalesce("component", "node").alias("class"))
    mixed_keys = rows.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count(F.lit(1)).alias("of")).where("x <> y").select("key", "of")
    return written(rows.join(mixed_keys, "key"), "mixed")


def across(rows: DataFrame, least: float) -> DataFrame:
    """(a, b): nodes of different classes that share a bucket of rows (key, node, n, at, class) and whose sizes and places there allow `least`.

    A bucket is cut into blocks of about `BLOCK` nodes; every two blocks meet under a key of their own.
    """
    blocks = F.ceil(F.col("of") / F.lit(float(BLOCK))).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.expr("sequence(0, blocks - 1)"))
    own = F.struct("node", "n", "at", "class")
    x = rows.select("key", F.col("block").alias("bx"), every.alias("by"), own.alias("x"))
    y = rows.select("key", every.alias("bx"), F.col("block").alias("by"), own.alias("y"))
    met = x.join(y, ["key", "bx", "by"]).where("x.node > y.node AND x.class <> y.class").where(may_be_like("x", "y", least))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def similar(docs: DataFrame, words: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, text_md5, digest) and the classes (digest, class) of different sets of shingles.

    Texts of equal sets are one node from the start. Nodes meet by their fingerprints
    (see `fingerprint_links`; those of one fingerprint meet its least node), and in the
    buckets of the first shingles of their sets (see `prefixes`), so all that are alike
    meet. In a bucket each is compared with the one before it and with the one whose
    shingles most others have; where that and the fingerprints leave a bucket more than
    one class, all pairs of different classes are compared.
    """
    with small_batches(docs.sparkSession):
        base = written(prefixes(docs, words, least, common_shingles(docs, words)), "prints")
    groups = base.groupBy("digest").agg(*(F.first(c).alias(c) for c in ("f", "n", "bins", "keys")))
    groups = written(groups.withColumn("node", F.monotonically_increasing_id()), "groups")
    found = written(base.select("doc_id", "text_md5", "digest"), "rows")
    removed(base)
    shown = groups.select("node", "n", F.posexplode("keys").alias("at", "key"))
    bucket = Window.partitionBy("key")
    met = written(shown.withColumn("size", F.count(F.lit(1)).over(bucket)).where("size > 1"), "met")
    # the first shingles are not needed any more
    whole, groups = groups, written(groups.drop("keys"), "groups")
    removed(whole)
    marks = written(groups.groupBy("f").agg(F.min("node").alias("root")), "marks")
    by_mark = root_links(marks, "root").union(groups.join(marks, "f").where("node <> root").select("node", "root"))
    # of a group of edited copies the original has the fewest shingles of its own
    known = met.groupBy("node").agg((F.sum(F.log2("size")) / F.max("n")).alias("known"))
    place = F.struct("node", "n", "at")
    first = met.join(known, "node").select("node", "n", "at", F.max(F.struct("known", "node", "n", "at")).over(bucket).alias("best"), F.lag(place).over(bucket.orderBy("n", "node")).alias("last"))
    first = first.select(place.alias("x"), F.explode(F.array(F.struct("best.node", "best.n", "best.at"), "last")).alias("y")).where("x.node <> y.node").where(may_be_like("x", "y", least))
    first = first.select("x.node", F.col("y.node").alias("other")).union(by_mark)
    tried = written(first.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct(), "pairs")
    removed(marks)
    rows = written(found.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_md5")).alias("row")), "first-rows")
    links = likes(tried, docs, groups, rows, words, least)
    rest = with_classes(met, links)
    removed(met)
    if not rest.isEmpty():
        more = written(across(rest, least).join(tried, ["a", "b"], "left_anti"), "pairs")
        links = links.union(likes(more, docs, groups, rows, words, least))
        removed(more)
    removed(rest, tried, rows)
    classes = groups.join(components(links), "node").select("digest", F.col("component").alias("class"))
    return found, classes


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles): distinct 64-bit hashes of the shingles of the whole texts of nodes (node, doc_id, text_md5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("text_md5", text_md5())
    if fits(nodes, HELD):
        # two numbers a node; as a broadcast table it would be many times that, most of it in the driver
        held = nodes.select(F.xxhash64("doc_id", "text_md5").alias("key"), "node").toArrow()
        keys, own = held.column("key").to_numpy(), held.column("node").to_numpy()
        order = np.argsort(keys)
        sent = docs.sparkSession.sparkContext.broadcast((keys[order], own[order]))

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, own = sent.value

            def ours(b: pa.RecordBatch) -> pa.RecordBatch:
                k = b.column(0).to_numpy()
                at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
                hit = np.flatnonzero(keys[at] == k) if len(keys) else np.zeros(0, np.int64)
                return pa.RecordBatch.from_arrays([pa.array(own[at[hit]]), b.column(1).take(pa.array(hit))], names=["node", "text"])

            return run(map(ours, batches))

        return rows.select(F.xxhash64("doc_id", "text_md5").alias("key"), "text").mapInArrow(chosen, "node bigint, shingles array<bigint>")
    nodes = nodes.toDF("node", "of_id", "of_md5")
    found = rows.join(nodes, (rows.text_md5 == nodes.of_md5) & rows.doc_id.eqNullSafe(nodes.of_id)).select("node", "text")
    return found.mapInArrow(run, "node bigint, shingles array<bigint>")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document, the one with the least doc_id (null last), of each group of near duplicates; all columns stay.

    Rows are told apart by doc_id and text; those that repeat both are one document.
    """
    released()
    md5 = "_text_md5"
    while md5 in docs.columns:
        md5 += "_"
    marked = docs.withColumn(md5, text_md5())
    if marked.groupBy("doc_id", md5).count().where("count > 1").limit(1).count():
        marked = written(marked.dropDuplicates(["doc_id", md5]), "distinct")
    rows, classes = similar(marked)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_md5")
    rows = rows.join(classes, "digest", "left").select("doc_id", "text_md5", F.struct("class", F.when(F.col("class").isNull(), F.col("digest")).alias("alone")).alias("class"), own.alias("own"))
    rows = written(rows, "classes")
    best = rows.groupBy("class").agg(F.min("own").alias("best"))
    losers = written(rows.join(best, "class").where("own <> best").select(F.col("doc_id").alias("of_id"), F.col("text_md5").alias("of_md5")), "losers")
    kept = marked.join(losers, (marked[md5] == losers.of_md5) & marked.doc_id.cast("bigint").eqNullSafe(losers.of_id), "left_anti")
    return kept.select(*docs.columns)


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return linked(*tables(spark, folder, "documents"))
