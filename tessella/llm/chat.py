"""Preference formatting, with DataFrame functions only.

Of a chosen and a rejected conversation the longest common prefix of turns is rendered once, as the prompt; the
rest of each becomes a completion with a mask: the spans of characters that are trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks around a turn, as in the ChatML layout.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
RESULTS = ("prompt_turns", "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask")
TURN = "array<struct<role: string, text: string>>"


def conversations(turns: DataFrame, ident: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv and its turns (array of role, text) in order; null roles and texts count as empty.

    Turns with one number are in the order of role and text. Null idents form one conversation.
    """
    one = F.struct(turns[turn].alias("turn"), F.coalesce(turns[role], F.lit("")).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text"))
    grouped = turns.groupBy(turns[ident].alias("conv")).agg(F.sort_array(F.collect_list(one)).alias("all"))
    return grouped.select("conv", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns at the start of both arrays are equal."""
    equal = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first_other = F.array_position(equal, False)
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(equal)).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def trained_spans(turns: Column, roles: tuple[str, ...]) -> Column:
    """The character spans (start, end) of the rendered turns that are trained on: texts and end marks of the given roles."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + len(OPEN) + F.length(t["role"]) + len(MIDDLE)
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"].isin(*roles), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format pairs of conversations, each an array of (role, text).

    Returns the other columns of pairs, and prompt_turns, prompt, chosen_text, chosen_mask, rejected_text and rejected_mask.
    The prompt is masked whole. Equal conversations have empty completions; a null conversation counts as empty;
    without a common turn the prompt is empty. No row is dropped, and an empty table gives an empty table. A column of pairs that has a result's name gives way to it.
    """
    a, b = (F.coalesce(pairs[c], F.array().cast(TURN)) for c in (chosen, rejected))
    others = [pairs[f"`{c}`"] for c in pairs.columns if c not in (chosen, rejected, *RESULTS)]
    split = pairs.select(*others, a.alias("__a"), b.alias("__b")).withColumn("prompt_turns", common_turns(F.col("__a"), F.col("__b")))
    rest = lambda c: F.expr(f"slice({c}, prompt_turns + 1, size({c}))")
    split = split.withColumn("prompt", rendered(F.expr("slice(__a, 1, prompt_turns)"))).withColumn("__a", rest("__a")).withColumn("__b", rest("__b"))
    return split.select("*", rendered(F.col("__a")).alias("chosen_text"), trained_spans(F.col("__a"), roles).alias("chosen_mask"), rendered(F.col("__b")).alias("rejected_text"), trained_spans(F.col("__b"), roles).alias("rejected_mask")).drop("__a", "__b")


def with_other_reply(convs: DataFrame) -> DataFrame:
    """Pairs (conv, chosen, rejected): each conversation against itself with the last turn of its neighbour.

    Conversations 2k and 2k + 1 are neighbours. Where one is missing, the rejected side has no last turn.
    """
    last = convs.select(F.col("conv").bitwiseXOR(F.lit(1).cast("bigint")).alias("neighbour"), F.element_at("turns", -1).alias("reply"))
    joined = convs.join(last, F.col("conv") == F.col("neighbour"), "left")
    before = F.expr("slice(turns, 1, size(turns) - 1)")
    other = F.when(F.col("reply").isNull(), before).otherwise(F.concat(before, F.array("reply")))
    return joined.select("conv", F.col("turns").alias("chosen"), other.alias("rejected"))
