"""Preference data from pairs of conversations: the common turns once as prompt, and two masked completions.

Everything is done turn by turn with DataFrame operations, so a conversation of any length is never held in one place:
the turns of both sides meet by pair and position, the first position where they differ is a minimum per
pair, and each turn is then rendered as part of the prompt or of a completion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import stored

ASSISTANT = "assistant"
UNKNOWN = "unknown"
END = "<|end|>"


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(pair_id, turn, nth, role, text)``: the turns of each conversation, ``nth`` telling apart those of one number.

    Rows without a conversation or a turn number belong to none and are left out, repeated rows count once. A null
    role is ``unknown``, a null text empty.
    """
    rows = conversations.select(
        F.col(conv).cast("long").alias("pair_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(UNKNOWN)).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = rows.filter("pair_id IS NOT NULL AND turn IS NOT NULL").distinct()
    nth = F.row_number().over(Window.partitionBy("pair_id", "turn").orderBy("role", "text"))
    return rows.select("pair_id", "turn", nth.alias("nth"), "role", "text")


def stale_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected side of each conversation: as it is up to its last reply, and with that reply taken from the one before.

    Where there is no reply before, the rejected one is empty. A conversation without any reply is on both sides as
    it is.
    """
    place = F.struct("turn", "nth")
    reply = F.col("role") == ASSISTANT
    last = stored(turns.groupBy("pair_id").agg(F.max(F.when(reply, place)).alias("last")), "last")
    with_last = turns.join(last, "pair_id")
    earlier = with_last.filter(reply & (place < F.col("last"))).groupBy("pair_id").agg(F.max(F.struct("turn", "nth", "text")).alias("e"))
    before = stored(earlier.select("pair_id", F.col("e.text").alias("stale")), "stale")
    chosen = with_last.filter(F.col("last").isNull() | (place <= F.col("last")))
    is_last = place == F.col("last")
    rejected = chosen.join(before, "pair_id", "left").withColumn(
        "text", F.when(F.coalesce(is_last, F.lit(False)), F.coalesce("stale", F.lit(""))).otherwise(F.col("text"))
    )
    columns = ["pair_id", "turn", "nth", "role", "text"]
    return chosen.select(columns), rejected.select(columns)


def preference_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``(pair_id, part, turn, nth, role, rendered, loss_start, loss_end)``, one row per rendered turn.

    ``part`` is ``prompt`` for the longest common beginning of both sides, rendered once, else ``chosen`` or
    ``rejected``. The loss is taken on the signs from ``loss_start`` to ``loss_end`` of ``rendered``: an assistant's text and its end
    mark in a completion; everything else is masked (0, 0). If both sides are equal all is prompt; if one side is the
    beginning of the other it has no completion.
    """
    sides = chosen.withColumn("_c", F.lit(True)).unionByName(rejected.withColumn("_c", F.lit(False)))
    said = F.struct("role", "text")
    met = stored(
        sides.groupBy("pair_id", "turn", "nth").agg(F.max(F.when(F.col("_c"), said)).alias("chosen"), F.max(F.when(~F.col("_c"), said)).alias("rejected")),
        "met",
    )
    place = F.struct("turn", "nth")
    differ = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    first = stored(met.groupBy("pair_id").agg(F.min(F.when(differ, place)).alias("first")), "first")
    common = F.col("first").isNull() | (place < F.col("first"))
    part = lambda name, turn: F.struct(F.lit(name).alias("part"), F.col(f"{turn}.role").alias("role"), F.col(f"{turn}.text").alias("text"))
    parts = F.when(common, F.array(part("prompt", "chosen"))).otherwise(
        F.filter(F.array(part("chosen", "chosen"), part("rejected", "rejected")), lambda p: p["role"].isNotNull())
    )
    rows = met.join(first, "pair_id").select("pair_id", "turn", "nth", F.explode(parts).alias("p")).select("pair_id", "p.part", "turn", "nth", "p.role", "p.text")
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    learned = (F.col("part") != "prompt") & (F.col("role") == ASSISTANT)
    return rows.select(
        "pair_id", "part", "turn", "nth", "role", F.concat(head, "text", F.lit(END + "\n")).alias("rendered"),
        F.when(learned, F.length(head)).otherwise(0).alias("loss_start"),
        F.when(learned, F.length(head) + F.length("text") + len(END)).otherwise(0).alias("loss_end"),
    )
