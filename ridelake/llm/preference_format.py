"""Preference formatting: one prompt and two masked completions for a chosen and a rejected conversation.

The prompt is the longest common prefix of turns, rendered once; what follows is rendered for each
side, with a mask that says which characters are to be learned (those of assistant turns).
Everything is a DataFrame expression; turns meet by conversation, and conversations by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands around a turn, and the role whose words are learned.
HEAD, BREAK, TAIL = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def conversations(turns: DataFrame, *, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turns): each conversation as an array of (turn, role, text), by turn.

    Repeated rows count once; different rows of one turn come by role and text. A null role or
    text is empty, a null turn comes first. Rows without a conversation are dropped.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return (
        turns.where(F.col(conv_id).isNotNull())
        .groupBy(F.col(conv_id).alias("conv_id"))
        .agg(F.sort_array(F.collect_set(turn)).alias("turns"))
    )


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns that two conversations share from the first one on (role and text)."""
    pairs = F.zip_with(
        a,
        b,
        lambda x, y: (x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]) & x.isNotNull()),
    )
    apart = F.array_position(F.transform(pairs, lambda same: same.cast("int")), 0)
    return F.when(apart > 0, apart - 1).otherwise(F.least(F.size(a), F.size(b)).cast("long")).cast("int")


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(BREAK), turn["text"], F.lit(TAIL))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def learned_spans(turns: Column, learned: str = LEARNED) -> Column:
    """(begin, stop) of the texts of learned turns, with their end mark, in the rendered turns."""
    state = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,stop:int>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(rendered(t))).alias("at"),
            F.when(
                t["role"] == learned,
                F.concat(
                    s["spans"],
                    F.array(
                        F.struct(
                            (s["at"] + F.length(t["role"]) + len(HEAD) + len(BREAK)).alias("begin"),
                            (s["at"] + F.length(rendered(t))).alias("stop"),
                        )
                    ),
                ),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
    )
    return state["spans"]


def format_preferences(pairs: DataFrame, turns: DataFrame, *, conv_id: str = "conv_id") -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask).

    ``pairs`` holds (pair_id, chosen_id, rejected_id). A pair needs both conversations; one with a
    null or unknown id gives no row, and repeated pairs give a row each. Completions may be empty
    (one conversation begins with the other, or both are equal). Masks are spans of characters.
    """
    whole = conversations(turns, conv_id=conv_id)
    chosen = whole.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"))
    rejected = whole.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b"))
    met = pairs.select("pair_id", "chosen_id", "rejected_id").join(chosen, "chosen_id").join(rejected, "rejected_id")
    cut = met.withColumn("n_prompt_turns", common_turns(F.col("a"), F.col("b")))
    n = F.col("n_prompt_turns")
    parts = cut.select(
        "pair_id",
        "n_prompt_turns",
        F.slice("a", F.lit(1), n).alias("shared"),
        F.slice("a", n + 1, F.size("a")).alias("a"),
        F.slice("b", n + 1, F.size("b")).alias("b"),
    )
    return parts.select(
        "pair_id",
        "n_prompt_turns",
        render(F.col("shared")).alias("prompt"),
        render(F.col("a")).alias("chosen"),
        learned_spans(F.col("a")).alias("chosen_mask"),
        render(F.col("b")).alias("rejected"),
        learned_spans(F.col("b")).alias("rejected_mask"),
    )


def neighbours(turns: DataFrame, *, conv_id: str = "conv_id") -> DataFrame:
    """Pairs of the conversations 2k (chosen) and 2k + 1 (rejected), where both are there."""
    ids = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("id"))
    pair = F.floor(F.col("id") / 2).cast("long")
    sides = ids.groupBy(pair.alias("pair_id")).agg(F.min("id").alias("chosen_id"), F.max("id").alias("rejected_id"))
    return sides.where(F.col("chosen_id") < F.col("rejected_id"))
