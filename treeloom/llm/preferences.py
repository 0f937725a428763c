"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

The longest common prefix of turns is rendered once as prompt.  What follows in each conversation is its completion,
with the spans of characters that count for training: the contents of assistant turns and the end marks after them.
All work is done by built-in functions; a pair's turns meet in one row, which is as long as the rendered result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import only

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _turns(table: DataFrame, name: str) -> DataFrame:
    turn = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return only(table, "pair_id", "turn", "role", "text").groupBy("pair_id").agg(F.sort_array(F.collect_list(turn)).alias(name))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that agree in role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x.role == y.role) & (x.text == y.text), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same))


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn.role, F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t.text, F.lit(END))), "")


def spans(turns: Column) -> Column:
    """``start, stop`` in characters of what assistants say, end mark included, in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc.at + F.length(head(t))
        stop = begin + F.length(t.text) + len(END)
        return F.struct(stop.alias("at"), F.when(t.role == "assistant", F.concat(acc.found, F.array(F.struct(begin.alias("start"), stop.alias("stop"))))).otherwise(acc.found).alias("found"))

    return F.aggregate(turns, start, step).found


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``pair_id, n_common, prompt, chosen, chosen_spans, rejected, rejected_spans`` for every pair with both sides.

    Inputs hold turns: ``pair_id, turn, role, text``; turns go by number, then role and text.  A null role is a
    user's, a null text is empty, a null ``pair_id`` is no pair.  Repeated rows are turns of their own.  If one
    conversation is a prefix of the other (or equal), its completion is empty and has no spans.
    """
    both = _turns(chosen.where("pair_id IS NOT NULL"), "a").join(_turns(rejected.where("pair_id IS NOT NULL"), "b"), "pair_id")
    both = both.withColumn("n", common_prefix(F.col("a"), F.col("b")).cast("int"))

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))

    return both.select(
        "pair_id",
        F.col("n").cast("long").alias("n_common"),
        render(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        render(rest("a")).alias("chosen"),
        spans(rest("a")).alias("chosen_spans"),
        render(rest("b")).alias("rejected"),
        spans(rest("b")).alias("rejected_spans"),
    )


def stale_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns of every conversation with an answer.

    Chosen is the conversation up to its last assistant turn; in the rejected one that turn repeats the assistant's
    answer before (or is empty if there is none).  A null turn number comes before all others.
    """
    c = only(conversations, "conv_id", "turn", "role", "text").withColumnRenamed("conv_id", "pair_id")
    answer = F.col("role") == "assistant"
    place = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)))
    of_pair = Window.partitionBy("pair_id")
    c = c.withColumn("last", F.max(F.when(answer, place)).over(of_pair))
    c = c.withColumn("before", F.lag("text").over(Window.partitionBy("pair_id", "role").orderBy("turn", "text")))
    c = c.where(F.col("pair_id").isNotNull() & (place <= F.col("last")))
    other = F.when(answer & (place == F.col("last")), F.coalesce("before", F.lit(""))).otherwise(F.col("text"))
    return c.select("pair_id", "turn", "role", "text"), c.select("pair_id", "turn", "role", other.alias("text"))


def span_text(column: str) -> Column:
    """Spans as text, ``start-stop`` joined by commas."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws("-", s.start, s.stop)), ",")
