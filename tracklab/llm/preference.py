"""Preference formatting, in DataFrame operations only.

The longest common turn prefix of a chosen and a rejected conversation is rendered once, as the prompt; the remaining turns of
each are its completion. A mask lists the spans of a completion that are trained on: the text and end mark of assistant turns.

Rendering: ``<|role|>``, a line end, the text, ``<|end|>``, a line end. Lengths and spans count code points, end exclusive.

Defined results: a null role or text equals only a null and is rendered as empty; turns are ordered by turn, role and text,
nulls first, so repeated turns stay next to each other; identical conversations have empty completions and are marked; rows
without a conversation id are ignored; a conversation missing on one side is an empty one; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklab.llm.common import cut_lineage

END = "<|end|>\n"


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns): the ordered turns of each conversation as an array of (role, text)."""
    rows = turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    return F.when(first == 0, shorter).otherwise(first.cast("int") - 1)


def _rest(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _render(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit(END))


def mask(turns: Column) -> Column:
    """Trained spans of a rendered completion as ``start:end``, comma-joined; one pass carries the position along."""

    def add(held: Column, t: Column) -> Column:
        start = held["at"] + F.length(F.coalesce(t["role"], F.lit(""))) + 5
        end = start + F.length(F.coalesce(t["text"], F.lit(""))) + len(END)
        span = F.concat_ws(":", start.cast("string"), (end - 1).cast("string"))
        more = F.when(held["spans"] == "", span).otherwise(F.concat(held["spans"], F.lit(","), span))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", more).otherwise(held["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.lit("").alias("spans")), add, lambda held: held["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """From (pair_id, chosen, rejected) with arrays of turns: prompt, completions, masks, number of common turns."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = pairs.select("pair_id", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    both = both.withColumn("n", common_turns(F.col("c"), F.col("r")))
    split = both.select("pair_id", "n", F.slice("c", 1, F.col("n")).alias("p"), _rest(F.col("c"), F.col("n")).alias("c"), _rest(F.col("r"), F.col("n")).alias("r"))
    return split.select(
        "pair_id",
        F.col("n").cast("long").alias("n_common"),
        rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"),
        rendered(F.col("r")).alias("rejected"),
        mask(F.col("c")).alias("chosen_mask"),
        mask(F.col("r")).alias("rejected_mask"),
        ((F.size("c") == 0) & (F.size("r") == 0)).alias("identical"),
    )


def assistant_chars(turns: Column) -> Column:
    own = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.aggregate(own, F.lit(0).cast("long"), lambda s, t: s + F.length(F.coalesce(t["text"], F.lit(""))))


def pair_by_opening(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, chosen, rejected): one pair per conversation.

    A conversation meets the one of smallest id with the same first turn; the side with more assistant text is chosen, the
    smaller id on a tie. That smallest one itself meets a stale form of itself: its last assistant turn answers with its
    first assistant text, or is missing if that is the same.
    """
    rows = conversations(turns)
    opening = F.md5(F.concat_ws("|", F.coalesce(F.get("turns", F.lit(0))["role"], F.lit("")), F.coalesce(F.get("turns", F.lit(0))["text"], F.lit(""))))
    rows = rows.withColumn("opening", opening)
    leads = rows.groupBy("opening").agg(F.min_by(F.struct("conv_id", "turns"), "conv_id").alias("lead"), F.count("*").alias("n"))
    # Read anew, so that the join can split an opening that very many conversations share.
    leads = cut_lineage(leads.where("n > 1").select("opening", F.col("lead.conv_id").alias("lead_id"), F.col("lead.turns").alias("lead_turns")))
    met = rows.join(leads, "opening", "left")
    other = F.col("lead_id").isNotNull() & (F.col("lead_id") != F.col("conv_id"))
    own, lead = assistant_chars(F.col("turns")), assistant_chars(F.col("lead_turns"))
    lead_wins = (lead > own) | (lead == own)  # the lead has the smaller id
    replies = F.filter("turns", lambda t: t["role"] == "assistant")
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: F.coalesce(t["role"] == "assistant", F.lit(False)))), True).cast("int") + 1
    answered = F.size(replies) > 0
    first_text, last_text = F.get(replies, F.lit(0))["text"], F.get("turns", last - 1)["text"]
    before = F.slice("turns", 1, F.greatest(last - 1, F.lit(0)))
    stale = F.when(~answered, F.slice("turns", 1, F.greatest(F.size("turns") - 1, F.lit(0)))).when(first_text.eqNullSafe(last_text), before).otherwise(
        F.concat(before, F.array(F.struct(F.lit("assistant").alias("role"), first_text.alias("text"))))
    )
    return met.select(
        F.col("conv_id").alias("pair_id"),
        F.when(other & lead_wins, F.col("lead_id")).otherwise(F.col("conv_id")).alias("chosen_id"),
        F.when(other & ~lead_wins, F.col("lead_id")).otherwise(F.col("conv_id")).alias("rejected_id"),
        F.when(other & lead_wins, F.col("lead_turns")).otherwise(F.col("turns")).alias("chosen"),
        F.when(other & lead_wins, F.col("turns")).when(other, F.col("lead_turns")).otherwise(stale).alias("rejected"),
    )
