"""Logged conversations: of those that grew turn by turn, keep the longest and render it.

The turns of a conversation are its distinct (turn, role, text) in that order. Null role counts as 'unknown', null text as
empty, rows without conv_id or turn are no turns. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pvspark.llm.shared import stored


def prefixes(conversations: DataFrame) -> DataFrame:
    """Every turn with its place and the rolling hash (two 64-bit halves) of the conversation up to it.

    The hash of a prefix is the exclusive or of hashes of (place, role, text): it rolls on by one turn at a time and can
    be summed in any order.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).dropna().distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("place", F.row_number().over(order).cast("long"))
    halves = [F.bit_xor(F.xxhash64(F.lit(k), "place", "role", "text")).over(order.rowsBetween(Window.unboundedPreceding, 0)) for k in (1, 2)]
    return turns.select("*", halves[0].alias("h1"), halves[1].alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """Of `prefixes` the conversations that no other one continues: conv_id, n_turns, n_copies.

    Of equal conversations the one with the smallest conv_id stays. Equal ones, and equal prefixes, are put together
    before they are compared, so a conversation or a first turn that a third of all rows share costs one row per task.
    """
    n = F.count("*").over(Window.partitionBy("conv_id"))
    turns = turns.select("conv_id", "place", "h1", "h2", n.alias("n"))
    whole = turns.filter("place = n").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    longer = turns.filter("place < n").select("place", "h1", "h2").distinct()
    rest = whole.join(longer, ["place", "h1", "h2"], "left_anti")
    return rest.select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and text (chat markup) of the maximal conversations."""
    turns = stored(prefixes(conversations), "turns")
    kept = maximal(turns)
    turn = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    rows = turns.join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", F.struct("place", turn.alias("turn")).alias("t"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda x: x["turn"]), "")
    return rows.groupBy("conv_id", "n_turns", "n_copies").agg(text.alias("text"))
