"""Preference pairs: the common turns of two conversations once as prompt, then both completions with loss masks.

A pair is two tables of turns.  The longest common turn prefix ends before the
first turn at which role or text differ or one side has none.  Turns before it
are rendered once, as prompt; the rest of each side is its completion.  Loss
falls on the assistant's turns of completions only.

The result has one row per rendered turn, so a conversation of any length is
never gathered: the first difference is an aggregate, rendering is row by row.

Defined cases: a null text is empty, a null role is "user".  Turns without a
pair id or number are left out.  A turn number that repeats inside one
conversation counts once (least role, then least text).  Sides that are equal
have a prompt and no completions.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgsieve.llm.common import as_columns


def render(role: Column, text: Column) -> Column:
    """A turn between its markers."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def clean_turns(turns: DataFrame) -> DataFrame:
    """pair_id, turn, role, text without nulls, one row per turn."""
    rows = as_columns(turns, pair_id="long", turn="long", role="string", text="string").where("pair_id is not null and turn is not null")
    rows = rows.select("pair_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("pair_id", "turn").agg(F.min(F.struct("role", "text")).alias("said")).select("pair_id", "turn", "said.role", "said.text")


def preference_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, part ("prompt", "chosen", "rejected"), turn, rendered, loss: in (part, turn) order the pair's training text.

    Both inputs have pair_id, turn, role, text; pairs that only one side has are left out.
    """
    left = clean_turns(chosen).select("pair_id", "turn", F.struct("role", "text").alias("chosen"))
    right = clean_turns(rejected).select("pair_id", "turn", F.struct("role", "text").alias("rejected"))
    both = left.join(right, ["pair_id", "turn"], "full")
    differs = F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("turn"))
    ends = both.groupBy("pair_id").agg(F.min(differs).alias("split"), F.count("chosen").alias("n_chosen"), F.count("rejected").alias("n_rejected"))
    rows = both.join(ends.where("n_chosen > 0 and n_rejected > 0").select("pair_id", "split"), "pair_id")
    common = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    sides = F.when(common, F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("said")))).otherwise(
        F.array(F.struct(F.lit("chosen").alias("part"), F.col("chosen").alias("said")), F.struct(F.lit("rejected").alias("part"), F.col("rejected").alias("said"))))
    turns = rows.select("pair_id", "turn", F.explode(sides).alias("side")).where("side.said is not null")
    loss = (F.col("side.part") != "prompt") & (F.col("side.said.role") == "assistant")
    return turns.select("pair_id", F.col("side.part").alias("part"), "turn", render(F.col("side.said.role"), F.col("side.said.text")).alias("rendered"), loss.alias("loss"))


def repeated_reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from plain conversations (conv_id, turn, role, text).

    Chosen is a conversation up to its last reply of the assistant.  Rejected
    is the same with the first reply said again instead of the last.
    Conversations with fewer than two replies make no pair.
    """
    turns = clean_turns(conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text"))
    reply = F.when(F.col("role") == "assistant", F.col("turn"))
    ends = turns.groupBy("pair_id").agg(F.min(reply).alias("first"), F.max(reply).alias("last"), F.min(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).alias("reply"))
    chosen = turns.join(ends.where("first < last"), "pair_id").where("turn <= last")
    rejected = chosen.withColumn("text", F.when(F.col("turn") == F.col("last"), F.col("reply.text")).otherwise(F.col("text")))
    return chosen.select("pair_id", "turn", "role", "text"), rejected.select("pair_id", "turn", "role", "text")


def _digest(*parts: Column) -> Column:
    """Eight hex digits of an MD5 as a number, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def every_conversation_pairs(conversations: DataFrame, group: int = 64) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns of every conversation (conv_id, turn, role, text).

    Chosen is the whole conversation.  Rejected is the same up to one reply of
    the assistant, the one with the least hash, and ends there with another
    text, so pairs part at any turn and the sides may differ in length.

    The other text is the reply of the next conversation in hash order, inside
    hash groups of about ``group`` conversations whose last one is followed by
    the first.  If it is the same text, the first that differs of the
    neighbour's least and greatest reply, the own least and greatest reply, an
    empty text and "no reply" is taken.  A conversation without a reply has
    nothing to reject: both sides are equal, all of it is prompt.
    """
    turns = clean_turns(conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text"))
    replies = turns.where("role = 'assistant'")
    ends = replies.groupBy("pair_id").agg(
        F.min(F.struct(_digest(F.col("pair_id"), F.col("turn")).alias("hash"), "turn", "text")).alias("at"), F.min("text").alias("least"), F.max("text").alias("most"))
    ends = ends.select("pair_id", F.col("at.turn").alias("last"), F.col("at.text").alias("reply"), "least", "most", _digest(F.col("pair_id")).alias("hash"))
    count = replies.agg(F.greatest(F.lit(1), F.floor(F.count_distinct("pair_id") / group)).cast("long").alias("groups"))
    dealt = ends.crossJoin(F.broadcast(count)).withColumn("group", F.col("hash") % F.col("groups"))
    ring = Window.partitionBy("group").orderBy("hash", "pair_id")
    says = F.struct("reply", "least", "most")
    near = F.coalesce(F.lead(says).over(ring), F.first(says).over(ring))
    found = [F.col("near.reply"), F.col("near.least"), F.col("near.most"), F.col("least"), F.col("most"), F.lit(""), F.lit("no reply")]
    other = F.coalesce(*[F.when(text != F.col("reply"), text) for text in found])
    swaps = dealt.withColumn("near", near).select("pair_id", "last", other.alias("other"))
    rejected = turns.join(swaps, "pair_id", "left").where("last is null or turn <= last")
    rejected = rejected.withColumn("text", F.when(F.col("turn") == F.col("last"), F.col("other")).otherwise(F.col("text")))
    return turns, rejected.select("pair_id", "turn", "role", "text")
