"""Conversations to training examples: every assistant turn with all that precedes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

# The control strings of the template.
OPEN = "### "
COLON = ": "
CLOSE = "</turn>"
CLOSE_ESCAPED = "<\\/turn>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """A text in which no control string is left; ``unescape`` gives it back."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    closed = F.replace(doubled, F.lit(CLOSE), F.lit(CLOSE_ESCAPED))
    return F.replace(closed, F.lit(OPEN), F.lit("\\" + OPEN))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(conversations: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """``(conv_id, example, text, loss_start, loss_length, turns, last)``.

    One example for each turn of ``trained_role``: the formatted conversation up to and
    with that turn, where only its reply, from ``loss_start`` (code points, from 0) over
    ``loss_length``, is trained.  Turns behind the last trained one, or a conversation
    without any, make a final example with no loss, so the output holds every turn;
    ``last`` marks the example that has them all.

    Turns are ordered by turn (null first), role, text; repeated rows stay repeated turns.
    Null texts and roles are empty ones; rows with a null ``conv_id`` are one conversation.
    An empty table gives no rows; other columns are ignored.  One conversation is held by
    one task, as its last example is one text."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(COLON))
    rows = rows.withColumn("head", head).withColumn("piece", F.concat("head", "body", F.lit(CLOSE + "\n")))
    one = Window.partitionBy("conv_id")
    along = one.orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.select(
        "conv_id", "piece", (F.col("role") == trained_role).alias("trained"), F.length("head").alias("head"),
        F.length("body").alias("body"), F.sum(F.length("piece").cast("long")).over(along).alias("end"),
        F.count(F.lit(1)).over(along).alias("turns"), F.count(F.lit(1)).over(one).alias("of"))
    turn = F.struct("turns", "trained", "head", "body", "end", (F.col("turns") == F.col("of")).alias("last"), "piece")
    whole = at.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("all")).select(
        "conv_id", F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("full"),
        F.transform(F.filter("all", lambda t: t["trained"] | t["last"]), lambda t: F.struct(
            *[t[k].alias(k) for k in ("turns", "trained", "head", "body", "end", "last")])).alias("targets"))
    out = whole.select("conv_id", "full", F.posexplode("targets").alias("example", "t"))
    start = F.col("t.end") - len(CLOSE) - 1 - F.col("t.body")
    return out.select(
        "conv_id", "example", F.substring("full", F.lit(1), F.col("t.end").cast("int")).alias("text"),
        F.when(F.col("t.trained"), start).otherwise(F.lit(0)).cast("long").alias("loss_start"),
        F.when(F.col("t.trained"), F.col("t.body")).otherwise(F.lit(0)).cast("long").alias("loss_length"),
        F.col("t.turns").alias("turns"), F.col("t.last").alias("last"))


def parse_turns(text: Column) -> Column:
    """A formatted text back to ``array<struct<role, text>>``."""
    parts = F.split(text, CLOSE + "\n")
    pattern = r"(?s)^### ((?:[^\\:]++|\\.)*+): (.*)$"
    return let(parts, lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), lambda s: F.struct(
        unescape(F.regexp_extract(s, pattern, 1)).alias("role"), unescape(F.regexp_extract(s, pattern, 2)).alias("text"))))


def loss_text(text: Column, start: Column, length: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return unescape(F.substring(text, (start + 1).cast("int"), length.cast("int")))


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from its examples alone."""
    taken = examples.select(
        "conv_id", "example", F.length("text").cast("long").alias("chars"), F.when(F.col("last"), F.col("text")).alias("whole"),
        loss_text(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("loss"))
    one = taken.groupBy("conv_id").agg(
        F.max("whole").alias("whole"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"))
    one = one.select("conv_id", "formatted_chars", parse_turns(F.col("whole")).alias("turns"),
                     F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return one.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")
