"""Preference formatting: longest common turn prefix of a chosen and a rejected conversation, rendered once, with masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def render(turns: Column) -> Column:
    """One string of an array of (turn, role, text): ``<|role|>``, newline, text, ``<|end|>``, newline for each turn."""
    return F.array_join(F.transform(turns, lambda t: _rendered(t)), "")


def _rendered(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))


def mask(turns: Column, trained_role: str) -> Column:
    """Character spans of a rendered completion that carry loss: text and end mark of the trained role's turns, ``start:end`` comma-joined."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["role"]) + 5
        end = begin + F.length(t["text"]) + 7
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        spans = F.when(t["role"] == trained_role, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((end + 1).cast("long").alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(turns, zero, step)["spans"], ",")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns equal in role and text."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.transform(
        F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), F.lit(1), F.greatest(shorter, F.lit(1))),
        lambda p: F.coalesce((p["x"]["role"] == p["y"]["role"]) & (p["x"]["text"] == p["y"]["text"]), F.lit(False)),
    )
    first_difference = F.array_position(same, False)
    return F.when(shorter == 0, F.lit(0).cast("long")).when(first_difference == 0, shorter.cast("long")).otherwise(first_difference - 1)


def format_preferences(turns: DataFrame, pair_id: Column, is_chosen: Column, trained_role: str = "assistant") -> DataFrame:
    """One row per pair: pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask, n_chosen, n_rejected.

    ``turns`` has turn, role and text; ``pair_id`` and ``is_chosen`` say which conversation of which pair a turn
    belongs to. Null role or text counts as empty, a null turn number sorts first, and turns that tie or repeat
    stand in order of role and text and are all kept. A side without turns is an empty conversation: the prompt is
    then empty and the other side is one completion. A turn with a null pair id belongs to no other turn: it is a pair of
    its own with a null id. A null ``is_chosen`` counts as rejected. An empty table gives no rows; other columns are not read.

    A row holds one pair of conversations, as its output must; the turns of a pair meet in one shuffle.
    """
    rows = turns.select(
        pair_id.alias("pair_id"),
        F.when(pair_id.isNull(), F.monotonically_increasing_id()).alias("_alone"),
        F.coalesce(is_chosen, F.lit(False)).alias("side"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    sides = rows.groupBy("pair_id", "_alone").agg(
        F.sort_array(F.collect_list(F.when(F.col("side"), F.col("t")))).alias("a"),
        F.sort_array(F.collect_list(F.when(~F.col("side"), F.col("t")))).alias("b"),
    )
    cut = sides.withColumn("n", common_prefix(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(F.col(c), (F.col("n") + 1).cast("int"), F.greatest(F.size(c), F.lit(1)))
    parts = cut.select("pair_id", "n", "a", "b", F.slice("a", F.lit(1), F.col("n").cast("int")).alias("p"), rest("a").alias("x"), rest("b").alias("y"))
    return parts.select(
        "pair_id",
        F.col("n").alias("prompt_turns"),
        render(F.col("p")).alias("prompt"),
        render(F.col("x")).alias("chosen"),
        mask(F.col("x"), trained_role).alias("chosen_mask"),
        render(F.col("y")).alias("rejected"),
        mask(F.col("y"), trained_role).alias("rejected_mask"),
        F.size("a").cast("long").alias("n_chosen"),
        F.size("b").cast("long").alias("n_rejected"),
    )
