"""Quotation linking of conversations (DataFrame functions only).

A line that starts with ``>`` marks is quoted; the number of marks is its
level, and neighbouring lines of one level are a passage. Passages and their
lines are normalised (lower case, letters and digits, single spaces) and
hashed, and so are the unquoted text of every message, its unquoted passages
and its lines. A quoted piece is linked with the latest earlier message of the
conversation that wrote it. A message answers the message its quotes at level
1 point to - a whole text or passage outweighs single lines, more pieces
outweigh fewer, the later message wins ties - and without a link the message
before it. Conversations come out without quotes, and without the line that
announces one, in reply order: (turn answered, own turn), in which an answer
always follows what it answers.

Nothing gathers a conversation: the latest earlier message and the positions
are found in slices of ``SLICE`` turns, and only one row per slice is ordered
across slices.

Edge cases: rows that repeat conversation, turn, role and text are one message
(``copies`` counts them); messages of one turn neither answer nor quote one
another; a null conversation is a conversation of its own; a null turn comes
before all others; a null or empty text is an empty message; a text of nothing
but quotes gives an empty clean text; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SLICE = 512
MARKS = r"^((?:[ \t]*>)+)"
FIRST = -(1 << 62)  # stands for a null turn
KEY = ["conv", "t", "msg"]


def level_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _slice(t: Column) -> Column:
    return F.floor(t / SLICE)


def messages(conversations: DataFrame) -> DataFrame:
    """Distinct messages with their keys: conv, t (turn), msg."""
    m = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    m = m.groupBy("conv_id", "turn", "role", F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    return m.select("conv_id", "turn", "role", "text", "copies", F.xxhash64("conv_id").alias("conv"), F.coalesce("turn", F.lit(FIRST)).alias("t"), F.xxhash64("role", "h").alias("msg"))


def clean_text(text: Column) -> Column:
    """The text without quoted lines and without a line that announces a quote."""
    lines = F.split(text, "\n")
    quoted = lambda x: x.rlike(MARKS)
    announces = lambda x, i: x.rlike(r"(?i)\bwrote:\s*$") & F.coalesce(F.get(lines, i + 1).rlike(MARKS), F.lit(False))
    return F.when(text.rlike(r"(?m)" + MARKS), F.trim(F.array_join(F.filter(lines, lambda x, i: ~quoted(x) & ~announces(x, i)), "\n"))).otherwise(text)


def pieces(m: DataFrame) -> DataFrame:
    """(conv, t, msg, level, kind, hash): normalised passages (kind 2) and lines (kind 1) by quote level."""
    lines = m.select(*KEY, F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("level", level_of(F.col("line")))
    lines = lines.withColumn("words", normal(F.regexp_replace("line", MARKS, "")))
    in_order = Window.partitionBy(*KEY).orderBy("i")
    starts = F.when(F.lag("level").over(in_order) == F.col("level"), 0).otherwise(1)
    lines = lines.withColumn("starts", starts).withColumn("run", F.sum("starts").over(in_order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "words"))), lambda x: x["words"]), " ")
    runs = lines.groupBy(*KEY, "run", "level").agg(text.alias("words")).select(*KEY, "level", F.lit(2).alias("kind"), F.trim(F.regexp_replace("words", " +", " ")).alias("words"))
    own = m.select(*KEY, F.lit(0).alias("level"), F.lit(2).alias("kind"), normal(clean_text(F.col("text"))).alias("words"))
    every = runs.union(lines.select(*KEY, "level", F.lit(1).alias("kind"), "words")).union(own)
    return every.where("words <> ''").select(*KEY, "level", "kind", F.xxhash64("words").alias("hash")).distinct()


def linked(p: DataFrame) -> DataFrame:
    """(conv, t, msg, level, kind, hash, original): quoted pieces with the latest earlier turn that wrote them."""
    group = ["conv", "kind", "hash"]
    wrote = p.where("level = 0").select(*group, "t").distinct().select(*group, "t", F.col("t").alias("origin"), F.lit(1).alias("late"))
    asks = p.where("level > 0").select(*group, "t").distinct().select(*group, "t", F.lit(None).cast("long").alias("origin"), F.lit(0).alias("late"))
    both = wrote.join(asks.select(*group).distinct(), group, "left_semi").union(asks).withColumn("slice", _slice(F.col("t")))
    both = cut_lineage(both, "quotes-events")
    inside = Window.partitionBy(*group, "slice").orderBy("t", "late").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.max("origin").over(inside)).where("late = 0")
    carry = both.groupBy(*group, "slice").agg(F.max("origin").alias("top"))
    earlier = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.withColumn("carried", F.max("top").over(earlier)).drop("top")
    found = near.join(carry, [*group, "slice"]).select(*group, "t", F.coalesce("near", "carried").alias("original")).where("original IS NOT NULL")
    return p.where("level > 0").join(found, [*group, "t"])


def previous_turns(m: DataFrame) -> DataFrame:
    """(conv, t, before): the turn before each turn of a conversation."""
    turns = m.select("conv", "t").distinct().withColumn("slice", _slice(F.col("t")))
    inside = Window.partitionBy("conv", "slice").orderBy("t")
    tops = turns.groupBy("conv", "slice").agg(F.max("t").alias("top"))
    tops = tops.withColumn("carried", F.lag("top").over(Window.partitionBy("conv").orderBy("slice"))).drop("top")
    return turns.withColumn("near", F.lag("t").over(inside)).join(tops, ["conv", "slice"]).select("conv", "t", F.coalesce("near", "carried").alias("before"))


def positions(m: DataFrame) -> DataFrame:
    """``m`` (conv, t, msg, answers) with its place in reply order."""
    a = F.coalesce("answers", F.lit(FIRST - 1))
    rows = m.withColumn("a", a).withColumn("ts", _slice(F.col("t"))).withColumn("s", _slice(F.col("a")))
    cells = rows.groupBy("conv", "s", "a", "ts").agg(F.count("*").alias("n"))
    tops = cells.groupBy("conv", "s").agg(F.sum("n").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("conv", "s", F.coalesce(F.sum("n").over(before("conv").orderBy("s")), F.lit(0)).alias("high"))
    cells = cells.select("conv", "s", "a", "ts", F.coalesce(F.sum("n").over(before("conv", "s").orderBy("a", "ts")), F.lit(0)).alias("low"))
    rows = rows.withColumn("own", F.row_number().over(Window.partitionBy("conv", "s", "a", "ts").orderBy("t", "msg")))
    out = rows.join(cells, ["conv", "s", "a", "ts"]).join(tops, ["conv", "s"])
    return out.withColumn("position", F.col("high") + F.col("low") + F.col("own")).drop("a", "ts", "s", "own", "low", "high")


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """Per message: conv_id, position, turn, role, reply_to, quoted (answers by a quote), n_quotes, quoted_turns, copies, text."""
    m = cut_lineage(messages(conversations), "quotes-messages")
    # conversations without a quote need no pieces
    quoting = m.where(F.col("text").rlike(r"(?m)" + MARKS)).select("conv").distinct()
    links = cut_lineage(linked(cut_lineage(pieces(m.join(quoting, "conv", "left_semi")), "quotes-pieces")), "quotes-links")
    votes = links.where("level = 1").groupBy(*KEY, "original").agg(F.max("kind").alias("kind"), F.count("*").alias("n"))
    best = votes.groupBy(*KEY).agg(F.max(F.struct("kind", "n", "original")).alias("best")).select(*KEY, F.col("best.original").alias("original"))
    quotes = links.groupBy(*KEY).agg(F.count_distinct("level", "hash").alias("n_quotes"), F.array_sort(F.collect_set("original")).alias("quoted_turns"))
    turns = previous_turns(m)
    out = m.join(best, KEY, "left").join(quotes, KEY, "left").join(turns, ["conv", "t"])
    out = out.withColumn("answers", F.coalesce("original", "before"))
    shown = lambda c: F.when(c != FIRST, c)
    return positions(out).select(
        "conv_id", "position", "turn", "role", shown(F.col("answers")).alias("reply_to"), F.col("original").isNotNull().alias("quoted"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.transform(F.coalesce("quoted_turns", F.array().cast("array<long>")), shown).alias("quoted_turns"),
        "copies", clean_text(F.col("text")).alias("text"),
    )
