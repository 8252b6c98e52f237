"""Chat formatting by quotation linking, with DataFrame functions alone.

Method
    A line's quote level is the number of ">" before its text. A passage is a run of lines of one
    level that are not blank; its text is its lines joined by spaces, lower-cased, with runs of white
    space as one space, so a quotation that was wrapped anew is still equal. Passages of level 0 are
    a message's own. Every quoted passage is hashed and linked to the latest own passage with the same
    hash and text of an earlier message of its conversation. A message replies to the latest message that
    its quotes link it to; without one, to the message before it. Quoted lines are then removed.

    Linking is a running maximum, not a join of quotes and originals: both stand in one order of
    (conversation, hash, turn), dealt into ranges, and a quote takes the last original before it. A
    range's first passage may have begun in earlier ranges, so their last original is carried over, one
    row for each range at most. A passage that is quoted and said very often costs its rows, not their pairs.

    Only conversations with a quoted line are cut into passages. Order in a conversation is by turn,
    then role and text, which puts every message after the one it replies to: ``reply_order`` is a
    message's place in it, not a walk of the tree of replies. It is taken from one
    range-partitioned order of all messages: a row's place in its range plus the rows of the ranges
    before, less the place of its conversation's first row. So neither a conversation nor a passage
    that very many messages hold is gathered into one task: equal own passages of a conversation are
    first reduced to their distinct turns.

Defined results
    * a null text has no passages and its body is null; an empty text has an empty body.
    * rows with a null conversation or turn link to nothing; null conversations are ordered as one.
    * repeated rows are messages like others and take successive places.
    * an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import ranges, written

QUOTED = r"(?m)^[ \t]*>"
QUOTED_LINE = r"(?m)^[ \t]*>[^\n]*(?:\n|\z)"


def passages(messages: DataFrame) -> DataFrame:
    """(uid, conv, turn, level, passage, text): the runs of one level of each message."""
    lines = messages.select("uid", "conv", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    mark = F.regexp_extract("line", r"^((?:[ \t]*>)*)", 1)
    lines = lines.withColumn("level", F.length(F.regexp_replace(mark, "[^>]", ""))).withColumn("body", F.trim(F.regexp_replace(F.lower(F.expr("substr(line, length(regexp_extract(line, '^((?:[ \\\\t]*>)*)', 1)) + 1)")), r"\s+", " ")))
    lines = lines.withColumn("kind", F.when(F.col("body") == "", F.lit(-1)).otherwise(F.col("level")))
    own = Window.partitionBy("uid").orderBy("at")  # one message's lines
    turned = F.when(F.col("kind") == F.lag("kind", 1, -2).over(own), 0).otherwise(1)
    lines = lines.withColumn("passage", F.sum(turned).over(own)).filter("kind >= 0")
    run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), " ")
    return lines.groupBy("uid", "conv", "turn", "level", "passage").agg(run.alias("text"))


def _linked(quotes: DataFrame, originals: DataFrame, parts: int) -> DataFrame:
    """(uid, n_linked, source) of messages with a quote that an earlier turn of their conversation says."""
    same = ["conv", "hash", "text"]
    quotes = quotes.filter("turn IS NOT NULL").select(*same, "turn", F.lit(0).alias("said"), "uid", "passage")
    own = originals.filter("turn IS NOT NULL").join(quotes.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi").select(*same, "turn").distinct()
    own = own.select(*same, "turn", F.lit(1).alias("said"), F.lit(None).cast("long").alias("uid"), F.lit(None).cast("long").alias("passage"))
    # what a turn says stands behind what it quotes
    events = quotes.union(own).repartitionByRange(parts, "conv", "hash", "turn", "said", "uid", "passage").withColumn("range", F.spark_partition_id())
    events = written(events, "quoted").withColumn("source", F.when(F.col("said") == 1, F.col("turn")))
    so_far = Window.partitionBy("range", *same).orderBy("turn", "said").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a range's rows at most
    earlier = Window.partitionBy(*same).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carried = events.groupBy("range", *same).agg(F.max("source").alias("last")).withColumn("carried", F.max("last").over(earlier)).filter("carried IS NOT NULL").drop("last")
    found = events.withColumn("source", F.max("source").over(so_far)).filter("said = 0")
    found = found.join(F.broadcast(carried), ["range", *same], "left").withColumn("source", F.coalesce("source", "carried")).filter("source IS NOT NULL")
    return found.groupBy("uid").agg(F.count(F.lit(1)).alias("n_linked"), F.max("source").alias("source"))


def link_quotes(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, n_quotes, n_linked, reply_to, reply_order, body), one row for each message."""
    spark = table.sparkSession
    parts = ranges(table)
    rows = table.select(*(F.col(f"`{c}`").cast(t).alias(n) for c, t, n in ((conv_col, "long", "conv"), (turn_col, "long", "turn"), (role_col, "string", "role"), (text_col, "string", "text"))))
    order = ["conv", "turn", "role", "text"]
    # equal rows are dealt out by their place in the input
    rows = rows.withColumn("deal", F.xxhash64(F.monotonically_increasing_id()))
    placed = rows.repartitionByRange(parts, *order, "deal").sortWithinPartitions(*order).withColumn("uid", F.monotonically_increasing_id())
    placed = written(placed.drop("deal"), "messages")
    # uid is the range in the high bits and the place in the range in the low 33
    of_range, in_range = F.shiftright("uid", 33), F.col("uid").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(of_range.alias("range")).agg(F.count(F.lit(1)).alias("m"))  # one row for each range
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("range", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    messages = placed.withColumn("range", of_range).join(F.broadcast(before), "range").withColumn("place", F.col("before") + in_range).drop("range", "before")

    quoting = placed.filter(F.col("text").rlike(QUOTED) & F.col("conv").isNotNull()).select("conv").distinct()
    found = written(passages(placed.join(quoting, "conv", "left_semi")).withColumn("hash", F.xxhash64("text")), "passages")
    quotes = found.filter("level > 0")
    linked = _linked(quotes, found.filter("level = 0"), parts)
    counted = quotes.groupBy("uid").agg(F.count(F.lit(1)).alias("n_quotes"))

    first = messages.groupBy(F.col("conv").alias("fc")).agg(F.min("place").alias("first"))
    previous = messages.select((F.col("place") + 1).alias("place"), F.col("conv").alias("pc"), F.col("turn").alias("pt"))
    out = messages.join(first, F.col("conv").eqNullSafe(F.col("fc")))
    out = out.join(previous, "place", "left").join(counted, "uid", "left").join(linked, "uid", "left")
    return out.select(
        F.col("conv").alias("conv_id"),
        "turn",
        "role",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("source", F.when(F.col("conv").eqNullSafe(F.col("pc")) & (F.col("place") > F.col("first")), F.col("pt"))).alias("reply_to"),
        (F.col("place") - F.col("first")).alias("reply_order"),
        F.trim(F.regexp_replace("text", QUOTED_LINE, "")).alias("body"),
    )


ORACLE = r"""
WITH m AS (
  SELECT conv_id, turn, role, text, row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS uid
  FROM conversations
), l AS (
  SELECT uid, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr FROM m
), k AS (
  SELECT uid, conv_id, turn, nr, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)*)', 1), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(lower(substr(line, length(regexp_extract(line, '^((?:[ \t]*>)*)', 1)) + 1)), '\s+', ' ', 'g')) AS body FROM l
), d AS (
  SELECT *, CASE WHEN body = '' THEN -1 ELSE level END AS kind FROM k
), e AS (
  SELECT *, CASE WHEN kind = lag(kind, 1, -2) OVER (PARTITION BY uid ORDER BY nr) THEN 0 ELSE 1 END AS turned FROM d
), f AS (
  SELECT *, sum(turned) OVER (PARTITION BY uid ORDER BY nr) AS passage FROM e
), p AS (
  SELECT uid, conv_id, turn, level, passage, string_agg(body, ' ' ORDER BY nr) AS text FROM f WHERE kind >= 0 GROUP BY ALL
), o AS (
  SELECT DISTINCT conv_id, turn AS source, text FROM p WHERE level = 0
), q AS (
  SELECT p.uid, p.passage, max(o.source) AS source FROM p LEFT JOIN o ON o.conv_id = p.conv_id AND o.text = p.text AND o.source < p.turn
  WHERE p.level > 0 GROUP BY ALL
), n AS (
  SELECT uid, count(*) AS n_quotes, count(source) AS n_linked, max(source) AS source FROM q GROUP BY uid
)
SELECT m.conv_id, m.turn, m.role, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked,
       coalesce(n.source, lag(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.uid)) AS reply_to,
       (row_number() OVER (PARTITION BY m.conv_id ORDER BY m.uid) - 1)::BIGINT AS reply_order,
       trim(regexp_replace(m.text, '(?m)^[ \t]*>[^\n]*(?:\n|\z)', '', 'g')) AS body
FROM m LEFT JOIN n ON n.uid = m.uid
"""


def quoting(table: DataFrame) -> DataFrame:
    """The messages of a table with what the two before them say quoted above their own text, for tables without quotes."""
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    marked = [F.concat(F.lit(m), F.replace(F.lag("text", n).over(before), F.lit("\n"), F.lit("\n" + m)), F.lit("\n")) for n, m in ((2, ">> "), (1, "> "))]
    return table.select("conv_id", "turn", "role", F.concat(*(F.coalesce(x, F.lit("")) for x in marked), "text").alias("text"))


QUOTING_ORACLE = ORACLE.replace(
    "\nWITH m AS (",
    r"""
WITH quoting AS (
  SELECT conv_id, turn, role, coalesce('>> ' || replace(lag(text, 2) OVER w, chr(10), chr(10) || '>> ') || chr(10), '')
    || coalesce('> ' || replace(lag(text, 1) OVER w, chr(10), chr(10) || '> ') || chr(10), '') || text AS text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), m AS (""",
).replace("FROM conversations\n)", "FROM quoting\n)")
