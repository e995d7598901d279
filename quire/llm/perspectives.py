"""Operator 3: chat formatting by multi-party perspective rotation.

Every participant of a conversation (each name in ``role`` but ``system``) is
once the assistant: the dialogue is rendered with that speaker's turns as the
assistant's, all others as named users, system turns as context, and a mask
that trains on the assistant's words alone.

A rendered dialogue is returned message by message: the text of a
perspective is the concatenation of its ``rendered`` by ``seq``, and
``start``/``stop`` and ``mask_start``/``mask_stop`` are code points in it.
So a conversation of any length is never held by one task: messages are
numbered by a range exchange, dealt into blocks of ``BLOCK`` messages, and
offsets are running sums within a block plus the sums of the blocks before.

Native: DataFrame functions only.

Texts and names cannot forge a turn: ``<|`` is rendered as ``<\\|``, and
``<\\|`` with a further backslash, so taking one away gives the text back; a
line break in a name is rendered as a space.

Defined results: messages go by turn (null last), role and text; equal rows
are a message each; roles lose the white space around them, a null or blank one is ``unknown``; a
null text is empty; rows without a conv_id are one conversation; a
conversation of system turns alone is rendered once, with a null speaker and
no mask; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import number_within
from ..session import materialize
from .common import null_safe_key, read

SYSTEM = "system"
UNKNOWN = "unknown"
BLOCK = 1024
CLOSE = "<|end|>\n"
_AROUND = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def messages(conversations: DataFrame) -> DataFrame:
    """Numbered messages: ckey, conv_id, seq (from 0), block, name, text."""
    name = F.regexp_replace(F.coalesce(F.col("role").cast("string"), F.lit("")), _AROUND, "")
    m = conversations.select(
        "conv_id", null_safe_key(F.col("conv_id")).alias("ckey"), F.col("turn").isNull().alias("late"), "turn",
        F.when(name == "", F.lit(UNKNOWN)).otherwise(name).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    m = number_within(m, ["ckey"], ["late", "turn", "name", "text"], "no").withColumn("seq", F.col("no") - 1)
    return m.select("conv_id", "ckey", "turn", "seq", F.floor(F.col("seq") / BLOCK).cast("long").alias("block"), "name", "text")


def speakers(numbered: DataFrame) -> DataFrame:
    """(ckey, block, speaker): every participant at every block of the conversation."""
    of = numbered.groupBy("ckey", "name").agg(F.max("block").alias("last"))
    last = of.groupBy("ckey").agg(F.max("last").alias("last"))
    own = of.where(F.col("name") != SYSTEM).select("ckey", F.col("name").alias("speaker"))
    return last.join(own, "ckey", "left").select("ckey", "speaker", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("block"))


def escaped(text: Column) -> Column:
    """The text without the opening of a mark."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def part_of(name: Column, speaker: Column) -> Column:
    return (F.when(name == SYSTEM, F.lit(SYSTEM)).when(name == speaker, F.lit("assistant")).otherwise(F.lit("user")))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, seq, turn, part, name, rendered, start, stop,
    trained, mask_start, mask_stop; one row per message and perspective."""
    numbered = materialize(messages(conversations), "messages")
    d = numbered.join(speakers(numbered), ["ckey", "block"])
    d = d.withColumn("part", part_of(F.col("name"), F.col("speaker")))
    lead = F.concat(F.lit("<|"), F.col("part"), F.lit("|>\n"), F.when(F.col("part") == "user", F.concat(escaped(F.regexp_replace("name", r"[\r\n]+", " ")), F.lit(": "))).otherwise(F.lit("")))
    d = d.withColumn("lead", lead).withColumn("rendered", F.concat(F.col("lead"), escaped(F.col("text")), F.lit(CLOSE)))
    by = ["ckey", "block", "speaker"]
    # a window holds one block of one perspective
    within = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("upto", F.sum(F.length("rendered")).over(within).cast("long"))
    sums = d.groupBy(*by).agg(F.max("upto").alias("n"))
    before = Window.partitionBy("ckey", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("ckey", "block", "speaker", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).where("base > 0")
    late = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    d = d.alias("d").join(sums.alias("s"), late, "left").select("d.*", F.coalesce("s.base", F.lit(0)).cast("long").alias("base"))
    stop = F.col("base") + F.col("upto")
    start = stop - F.length("rendered")
    trained = F.col("part") == "assistant"
    return d.select(
        "conv_id", "speaker", "seq", "turn", "part", "name", "rendered", start.cast("long").alias("start"), stop.cast("long").alias("stop"),
        trained.alias("trained"), F.when(trained, start + F.length("lead")).cast("long").alias("mask_start"),
        # the end mark is learnt as well
        F.when(trained, stop - 1).cast("long").alias("mask_stop"))


def op3_perspective_rotation(spark, sf_dir: str) -> DataFrame:
    return rotate(read(spark, sf_dir, "conversations"))
