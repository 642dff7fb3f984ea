"""Preference formatting of chosen and rejected conversations.

Of each pair the longest common prefix of turns (same role and text at the same place) is found and
rendered once as the prompt; what follows on either side is its completion. A mask of run lengths
goes with each completion: `17x0,212x1` means 17 characters not to be learned, then 212 to be
learned. Learned are the texts of assistant turns with their closing mark; headers and turns of
other roles are not.

A pair is one row of the result, so its turns meet in one task and no more than that. Conversation
2k is the chosen and 2k + 1 the rejected side of pair k unless the caller brings a pairing of its
own. Turns are ordered by turn number (null last), then role and text, so ties and repeated rows
have a fixed place. Null role or text renders as empty and equals null only. A missing side is an
empty completion, and there is no common prefix then. Rows without conv_id belong to no
conversation and are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"


def by_parity(conversations: DataFrame) -> DataFrame:
    """Turns with pair_id and chosen, paired by conversation number."""
    return conversations.where("conv_id is not null").select(
        F.shiftright("conv_id", 1).alias("pair_id"),
        (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"),
        "turn",
        "role",
        "text",
    )


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    def runs(turn: Column) -> Column:
        head, body = F.length(_header(turn)), F.length(_body(turn))
        return F.when(
            turn["role"] == LEARNED_ROLE, F.concat(head, F.lit("x0,"), body, F.lit("x1"))
        ).otherwise(F.concat((head + body), F.lit("x0")))

    return F.array_join(F.transform(turns, runs), ",")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Prompt and masked completions of every pair; turns come with pair_id and chosen."""
    place = F.coalesce(F.col("turn").cast("long"), F.lit(2**63 - 1))
    entry = F.struct(place.alias("turn"), F.col("role"), F.col("text"))
    side = lambda mine: F.array_sort(F.collect_list(F.when(mine, entry)))
    both = turns.groupBy("pair_id").agg(
        side(F.col("chosen")).alias("_c"), side(~F.col("chosen")).alias("_r")
    )
    same = F.zip_with(
        "_c",
        "_r",
        lambda a, b: a.isNotNull()
        & b.isNotNull()
        & a["role"].eqNullSafe(b["role"])
        & a["text"].eqNullSafe(b["text"]),
    )
    first_other = F.array_position(same, False)
    shared = F.when(first_other > 0, first_other - 1).otherwise(F.size("_c")).cast("int")
    cut = both.withColumn("n_prompt_turns", shared)
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c), F.lit(1)))
    return cut.select(
        "pair_id",
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        _rendered(F.slice("_c", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        _rendered(rest("_c")).alias("chosen"),
        _mask(rest("_c")).alias("chosen_mask"),
        _rendered(rest("_r")).alias("rejected"),
        _mask(rest("_r")).alias("rejected_mask"),
    )
