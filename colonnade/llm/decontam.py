"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are hashed; of every 6 consecutive 5-grams the least hash is kept (the leftmost
of equals). Any shared span of 10 words holds 6 such 5-grams on both sides, so it shares
a kept one: joining the kept hashes of documents with those of benchmark items finds
every such span. Each hit is extended: its 15 words around are cut into the windows of
ten that hold it, and those are compared with the items' windows word by word (as
sequences of 64-bit word hashes).

An item of fewer than 10 words, but not none, is one window; windows of each such
length are looked up as they are. Null texts have no words. Rows that repeat a doc_id
and text count as often as they occur, also with a null doc_id; item_ids count once, a
null one not at all; other columns are passed over, whatever their names. Very long
texts are cut whole; their hits are gathered by stretches of words. Ties, equal hashes in
a window of 5-grams, change nothing in the result. Without items nothing is
contaminated; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colonnade.llm.common import fits, removed, tables, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words; A-Z are lowered afterwards, which joins and splits none.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GRAM, SPAN, WINDOW = 5, 6, 10
#: Words of a document whose hits are counted in one place.
STRETCH = 4096


def lowered(word: Column) -> Column:
    """A-Z only; the built-in lower() does just that on ASCII words, and faster."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _hashed(df: DataFrame, *keep: str) -> DataFrame:
    """keep, hw: hashes of the words."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), BETWEEN), lambda w: w != "")
    return df.select(*keep, F.transform(words, lambda w: F.xxhash64(lowered(w))).alias("hw"))


def _kept(df: DataFrame, *keep: str) -> DataFrame:
    """keep, hw, kg, at: hashes of the 5-grams, and the places of those that winnowing keeps."""
    gram = ", ".join(f"hw[i + {j}]" for j in range(GRAM))
    least = ", ".join(f"kg[i + {j}]" for j in range(SPAN))
    first = " ".join(f"WHEN kg[i + {j}] = low[i] THEN {j}" for j in range(SPAN - 1))
    seq = lambda n: f"IF({n} >= 0, sequence(0, greatest({n}, 0)), cast(array() AS array<int>))"
    df = df.selectExpr(*keep, "hw", f"transform({seq(f'size(hw) - {GRAM}')}, i -> xxhash64({gram})) AS kg")
    df = df.selectExpr(*keep, "hw", "kg", f"transform({seq(f'size(kg) - {SPAN}')}, i -> least({least})) AS low")
    # the least hash's place is another only where the hash changes or its place has just left the window
    moved = "i -> i = 0 OR low[i] <> low[greatest(i - 1, 0)] OR kg[greatest(i - 1, 0)] = low[greatest(i - 1, 0)]"
    df = df.selectExpr(*keep, "hw", "kg", "low", f"filter({seq('size(low) - 1')}, {moved}) AS at")
    return df.selectExpr(*keep, "hw", "kg", f"transform(at, i -> i + CASE {first} ELSE {SPAN - 1} END) AS at")


def _short(n: int) -> str:
    """The entries of all windows of n words: place, hash, first word of the context, context, length."""
    cells = ", ".join(f"hw[i + {j}]" for j in range(n))
    return f"transform(IF(size(hw) >= {n}, sequence(0, greatest(size(hw) - {n}, 0)), cast(array() AS array<int>)), i -> named_struct('fp', xxhash64({n}, {cells}), 'first', i, 'context', slice(hw, i + 1, {n}), 'len', {n}))"


def _once(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is small enough."""
    return F.broadcast(df) if fits(df) else df


def _hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written: rows (doc_id, digest, n_words, start, end, window), and (window, item_id).

    Every row of docs gives one with n_words, and each place of a window in it one without.
    """
    items = _hashed(benchmark.select("item_id", "text"), "item_id").withColumn("n", F.size("hw")).where("n > 0")
    items = written(items, "items")
    lengths = sorted(r["n"] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())  # nine at most
    held = items.select("item_id", F.explode(F.expr(f"transform(sequence(0, greatest(n - {WINDOW}, 0)), i -> slice(hw, i + 1, {WINDOW}))")).alias("known"))
    windows = written(held.select("known").distinct().select(F.monotonically_increasing_id().alias("window"), "known", F.xxhash64("known").alias("wk")), "windows")
    of_window = written(held.join(_once(windows.select("window", "known")), "known").select("window", "item_id").distinct(), "item-windows")
    prints = _kept(items.where(F.col("n") >= WINDOW).select("item_id", "hw"), "item_id").select(F.explode(F.expr("transform(at, p -> kg[p])")).alias("fp"))
    for n in lengths:
        prints = prints.union(items.where(F.col("n") == n).select(F.explode(F.expr(_short(n)))).select("col.fp"))
    prints = written(prints.distinct().withColumn("is_print", F.lit(True)), "item-prints")

    before = WINDOW - GRAM
    around = f"named_struct('fp', kg[p], 'first', greatest(p - {before}, 0), 'context', slice(hw, greatest(p - {before}, 0) + 1, p + {WINDOW} - greatest(p - {before}, 0)), 'len', {WINDOW})"
    entries = ", ".join([f"transform(at, p -> {around})", *map(_short, lengths)])
    docs = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    texts = _kept(_hashed(docs, "doc_id", "digest"), "doc_id", "digest")
    cut = "transform(IF(size(context) >= len, sequence(0, greatest(size(context) - len, 0)), cast(array() AS array<int>)), j -> named_struct('start', first + j, 'win', slice(context, j + 1, len)))"
    none = F.lit(None).cast("int")
    if fits(prints) and fits(windows):
        # one pass: an entry without a hash stands for the document itself and goes through both joins
        itself = "array(named_struct('fp', cast(NULL AS bigint), 'first', -1, 'context', cast(NULL AS array<bigint>), 'len', 0))"
        rows = texts.select("doc_id", "digest", F.size("hw").alias("n_words"), F.explode(F.expr(f"concat({itself}, {entries})")).alias("e")).select("doc_id", "digest", "n_words", "e.*")
        found = rows.join(F.broadcast(prints), "fp", "left").where("is_print OR first < 0")
        found = found.select("doc_id", "digest", F.expr("IF(first < 0, n_words, NULL)").alias("n_words"), "len", F.explode_outer(F.expr(cut)).alias("e")).select("doc_id", "digest", "n_words", "len", "e.*")
        hits = found.withColumn("wk", F.xxhash64("win")).join(F.broadcast(windows), "wk", "left").withColumn("hit", F.expr("coalesce(win = known, false)"))
        end = F.when(F.col("hit"), F.col("start") + F.col("len"))
        rows = hits.where("hit OR n_words IS NOT NULL").select("doc_id", "digest", "n_words", F.when(F.col("hit"), F.col("start")).alias("start"), end.alias("end"), F.when(F.col("hit"), F.col("window")).alias("window"))
    else:
        found = texts.select("doc_id", "digest", F.explode(F.expr(f"concat({entries})")).alias("e")).select("doc_id", "digest", "e.*").join(prints, "fp")
        found = found.select("doc_id", "digest", "len", F.explode(F.expr(cut)).alias("e")).select("doc_id", "digest", "len", "e.*").withColumn("wk", F.xxhash64("win"))
        hits = found.join(windows, "wk").where("win = known").select("doc_id", "digest", none.alias("n_words"), "start", (F.col("start") + F.col("len")).alias("end"), "window")
        own = _hashed(docs, "doc_id", "digest").select("doc_id", "digest", F.size("hw").alias("n_words"), none.alias("start"), none.alias("end"), F.lit(None).cast("bigint").alias("window"))
        rows = own.union(hits)
    rows = written(rows, "hits")
    removed(items, windows, prints)
    return rows, of_window


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, digest, n_words, n_hit, items, copies): a row for each different doc_id and text.

    Hits carry the number of a window, never the items that hold it; those meet each
    document once. Covered words are counted by stretches of `STRETCH` words.
    """
    rows, of_window = _hits(docs, benchmark)
    own = rows.where("n_words IS NOT NULL").groupBy("doc_id", "digest").agg(F.max("n_words").cast("bigint").alias("n_words"), F.count("n_words").alias("copies"))
    hits = rows.where("window IS NOT NULL")
    stretch = hits.select("doc_id", "digest", "start", "end", F.explode(F.expr(f"sequence(start div {STRETCH}, (end - 1) div {STRETCH})")).alias("part"))
    stretch = stretch.select("doc_id", "digest", "part", F.struct(F.greatest("start", F.col("part") * STRETCH).alias("start"), F.least("end", (F.col("part") + 1) * STRETCH).alias("end")).alias("hit"))
    covered = "aggregate(array_sort(hits), named_struct('n', 0L, 'reach', 0L), (a, x) -> named_struct('n', a.n + greatest(0L, x.end - greatest(a.reach, x.start)), 'reach', greatest(a.reach, x.end)), a -> a.n)"
    stretch = stretch.groupBy("doc_id", "digest", "part").agg(F.collect_set("hit").alias("hits")).select("doc_id", "digest", F.expr(covered).alias("n"))
    n_hit = stretch.groupBy("doc_id", "digest").agg(F.sum("n").alias("n_hit"))
    ids = hits.select("doc_id", "digest", "window").distinct().join(_once(of_window), "window").groupBy("doc_id", "digest").agg(F.collect_set("item_id").alias("items"))
    more = n_hit.withColumnsRenamed({"doc_id": "d", "digest": "g"}).join(ids, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("g") == F.col("digest"))).select("d", "g", "n_hit", "items")
    out = own.join(more, own["doc_id"].eqNullSafe(F.col("d")) & (own["digest"] == F.col("g")), "left")
    return out.select("doc_id", "digest", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast(ids.schema["items"].dataType)).alias("items"), "copies")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold any window of an item; all columns stay, whatever their names."""
    rows, of_window = _hits(docs, benchmark)
    bad = written(rows.where("window IS NOT NULL").select("doc_id", "digest").distinct().toDF("bad_id", "bad_digest"), "contaminated")
    removed(rows, of_window)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*names.values()).withColumn("digest", F.md5(F.coalesce(names["text"], F.lit("")).cast("binary")))
    same = own[names["doc_id"]].eqNullSafe(F.col("bad_id")) & (own["digest"] == F.col("bad_digest"))
    return own.join(_once(bad), same, "left_anti").select(*(F.col(n).alias(c) for c, n in names.items()))


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(*tables(spark, folder, "documents", "benchmark"))
    ids = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    out = found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("_"))
    return out.drop("_")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS win
  FROM b, unnest(range(greatest(len(w) - 9, 1))) AS r(i) WHERE len(w) > 0),
dw AS (SELECT rid, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT rid, cast(item_id AS varchar) AS x FROM hit) GROUP BY rid)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN ids USING (rid)"""
