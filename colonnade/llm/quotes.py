"""Conversations in reply order from quoted messages, in DataFrame operations only.

A line's quote level is the number of `>` in front of it. Every quoted line is
normalised (lower case, letters and digits only) and hashed; the original of a quoted
line is the earliest message of the conversation that has the line as its own, if that
comes before the quoting message. A message answers the original that most of its
quoted lines of the lowest level with any original come from (the later one of equals);
a message without such lines answers the turn before it. Depths and first messages follow
from the links by doubling, and (root_turn, depth, turn) is the reply order. The text is
kept without quoted lines and lines that only announce a quote.

Messages are told apart by conv_id and turn; repeated rows share their links and stay.
Rows with a null conv_id or turn stand alone: no parent, depth 0. A null text stays null
and quotes nothing. Other columns are passed over.

A line that many messages share is one row of the index (its earliest message), so it
costs each quoting line one match. Turns are followed in ranges of `SPAN`, so no task
holds a long conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from colonnade.llm.common import tables, written

SPAN = 1024
QUOTE = r"^((?:[ \t]*>)+)[ \t]?"
ANNOUNCED = r"^On .+ wrote:[ \t]*$"


def _lines(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, key: a row for each line that has a letter or digit."""
    lines = messages.select("conv_id", "turn", F.explode(F.split("text", r"\r?\n")).alias("line"))
    lines = lines.select("conv_id", "turn", "line", F.regexp_extract("line", QUOTE, 1).alias("marks"))
    level = F.char_length(F.regexp_replace("marks", "[^>]", ""))
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace("line", QUOTE, "")), r"[^\p{L}\p{N}]+", " "))
    lines = lines.select("conv_id", "turn", level.alias("level"), plain.alias("plain"))
    return lines.where("plain <> ''").select("conv_id", "turn", "level", F.unhex(F.md5(F.col("plain").cast("binary"))).alias("key"))


def _before(turns: DataFrame) -> DataFrame:
    """conv_id, turn, before: distinct turns, each with the one before it."""
    spans = turns.withColumn("span", F.floor(F.col("turn") / SPAN))
    tops = spans.groupBy("conv_id", "span").agg(F.max("turn").alias("top"))
    tops = tops.select("conv_id", "span", F.lag("top").over(Window.partitionBy("conv_id").orderBy("span")).alias("below"))
    inner = spans.withColumn("before", F.lag("turn").over(Window.partitionBy("conv_id", "span").orderBy("turn")))
    return inner.join(tops, ["conv_id", "span"]).select("conv_id", "turn", F.coalesce("before", "below").alias("before"))


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, quoted, depth, root_turn for each different conv_id and turn."""
    messages = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    lines = written(_lines(messages), "lines")
    index = lines.where("level = 0").groupBy("conv_id", "key").agg(F.min("turn").alias("origin"))
    found = lines.where("level > 0").join(index, ["conv_id", "key"]).where("origin < turn")
    votes = found.groupBy("conv_id", "turn", "level", "origin").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), "n", "origin")).alias("v")).select("conv_id", "turn", F.col("v.origin").alias("origin"))
    turns = _before(messages.select("conv_id", "turn").distinct())
    now = turns.join(best, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("origin", "before").alias("parent_turn"), F.col("origin").isNotNull().alias("quoted"))
    # up: an ancestor; depth: the way to it; both double until a message has met its root and is set aside
    now = written(now.select("*", F.col("parent_turn").alias("up"), F.when(F.col("parent_turn").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.coalesce("parent_turn", "turn").alias("root_turn")), "links")
    done, now = now.where("up IS NULL"), now.where("up IS NOT NULL")
    while not now.isEmpty():
        above = done.union(now).select("conv_id", F.col("turn").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("root_turn").alias("_root"))
        met = written(now.join(above, ["conv_id", "up"]).select("conv_id", "turn", "parent_turn", "quoted", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_root").alias("root_turn")).select(*done.columns), "links")
        done, now = done.union(met.where("up IS NULL")), met.where("up IS NOT NULL")
    return done.drop("up")


def unquoted(text: str) -> Column:
    own = F.filter(F.split(text, r"\r?\n"), lambda x: ~x.rlike(QUOTE) & ~x.rlike(ANNOUNCED))
    return F.regexp_replace(F.array_join(own, "\n"), r"^\n+|\n+$", "")


def threaded(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, parent_turn, quoted, depth, root_turn, text."""
    rows = messages.select("conv_id", "turn", "role", unquoted("text").alias("text"))
    out = rows.join(links(messages.select("conv_id", "turn", "text")), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "parent_turn", F.coalesce("quoted", F.lit(False)).alias("quoted"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), F.coalesce("root_turn", "turn").alias("root_turn"), "text")


def op2_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return threaded(*tables(spark, folder, "conversations"))


OP2_SQL = r"""
WITH RECURSIVE raw AS (SELECT DISTINCT conv_id, turn, unnest(regexp_split_to_array(text, '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS k, text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL),
lines AS (SELECT conv_id, turn, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level,
  trim(regexp_replace(lower(regexp_replace(line, '^((?:[ \t]*>)+)[ \t]?', '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS plain FROM raw),
origin AS (SELECT conv_id, plain, min(turn) AS origin FROM lines WHERE level = 0 AND plain <> '' GROUP BY ALL),
votes AS (SELECT conv_id, turn, level, origin, count(*) AS n FROM lines JOIN origin USING (conv_id, plain) WHERE level > 0 AND origin < turn GROUP BY ALL),
best AS (SELECT conv_id, turn, origin FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, origin DESC) = 1),
turns AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
link AS (SELECT conv_id, turn, coalesce(origin, before) AS parent_turn, origin IS NOT NULL AS quoted FROM turns LEFT JOIN best USING (conv_id, turn)),
tree AS (SELECT conv_id, turn, cast(0 AS bigint) AS depth, turn AS root_turn FROM link WHERE parent_turn IS NULL
  UNION ALL SELECT link.conv_id, link.turn, depth + 1, root_turn FROM tree JOIN link ON link.conv_id = tree.conv_id AND link.parent_turn = tree.turn)
SELECT c.conv_id, c.turn, c.role, parent_turn, coalesce(quoted, false) AS quoted, coalesce(depth, 0) AS depth, coalesce(root_turn, c.turn) AS root_turn,
  regexp_replace(array_to_string(list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: NOT regexp_matches(x, '^((?:[ \t]*>)+)[ \t]?') AND NOT regexp_matches(x, '^On .+ wrote:[ \t]*$')), chr(10)), '^\n+|\n+$', '', 'g') AS text
FROM conversations c LEFT JOIN link USING (conv_id, turn) LEFT JOIN tree USING (conv_id, turn)"""
