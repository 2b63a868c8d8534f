"""Preference formatting of paired conversations.

The turns that a chosen and a rejected conversation share from the start are rendered once, as the prompt; what follows on
either side is its completion. A completion's mask names the signs that count for a loss: the texts of assistant turns
and the mark that ends them, never the marks that open a turn nor other roles' words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """Begin and end (after the end mark) of each assistant turn's text, in signs of the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def add(state, t):
        begin = state["at"] + F.length(t["role"]) + F.lit(len(OPEN) + len(CLOSE))
        end = begin + F.length(t["text"]) + F.lit(len(END))
        spans = F.when(t["role"] == "assistant", F.concat(state["spans"], F.array(F.struct(begin.alias("begin"), end.alias("end"))))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, add, lambda s: s["spans"])


def format_preferences(turns: DataFrame, pair_col: str = "pair_id", side_col: str = "side", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per pair with both sides: pair_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask.

    turns has a row for each turn: its pair, its side ("chosen" or "rejected"; rows of others are left out), number, role and text.
    Turns are in order of number, role and text, nulls first, so repeated rows stay and ties have one order; a null role is
    "unknown" and a null text empty. Equal conversations give empty completions, conversations without a common
    start an empty prompt; a pair that lacks a side or has a null pair_id gives no row. A conversation is one
    row of its pair, as its rendering is; other columns are not read.
    """
    turn = F.struct(F.col(turn_col).alias("n"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col(side_col) == name, turn)), _by_turn)
    paired = turns.filter(F.col(pair_col).isNotNull() & F.col(side_col).isin("chosen", "rejected")).groupBy(F.col(pair_col).alias("pair_id")).agg(side("chosen").alias("c"), side("rejected").alias("r"))
    paired = paired.filter((F.size("c") > 0) & (F.size("r") > 0))
    same = lambda i: (F.col("c")[i]["role"] == F.col("r")[i]["role"]) & (F.col("c")[i]["text"] == F.col("r")[i]["text"])
    places = F.sequence(F.lit(0), F.least(F.size("c"), F.size("r")) - 1)
    # ends at the first turn that differs
    common = F.aggregate(places, F.lit(0), lambda k, i: F.when((k == i) & same(i), k + 1).otherwise(k))
    paired = paired.withColumn("n_prefix", common)
    rest = lambda c: F.slice(c, F.col("n_prefix") + 1, F.size(c))
    paired = paired.select("pair_id", "n_prefix", F.slice("c", 1, F.col("n_prefix")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return paired.select("pair_id", "n_prefix", _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"))


def _by_turn(a: Column, b: Column) -> Column:
    order = F.lit(0)
    for f in ("text", "role", "n"):
        order = F.when(a[f].eqNullSafe(b[f]), order).when(a[f].isNull() | (a[f] < b[f]), F.lit(-1)).otherwise(F.lit(1))
    return order
