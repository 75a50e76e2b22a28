"""Conversations stored one turn per row (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgpipe.functions.content import content_text

SEPARATOR = "\n\n"
# Turns per partial join of system texts; see system_prompts.
_CHUNK = 1000


def _normalized(df: DataFrame) -> DataFrame:
    text = F.col("text")
    if dict(df.dtypes)["text"] == "variant":
        text = content_text(text)
    return df.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"),
                     F.coalesce(text, F.lit("")).alias("text"))


def conversation_turns(df: DataFrame) -> DataFrame:
    """The turns that are not system texts, still one per row and ordered by ``turn``.

    Needs no shuffle, so a conversation of any length stays spread out.
    """
    return _normalized(df).filter(F.col("role") != "system")


def _summed(df: DataFrame) -> DataFrame:
    """Per conversation: system text (NULL if none), number and total length of turns.

    Done in two steps: chunks of turns first, then the chunks, so a long conversation is
    spread over many tasks before its one text is formed. One pass over the turns.
    """
    is_system = F.col("role") == "system"

    def joined(order: str, text: Column) -> Column:
        ordered = F.array_sort(F.collect_list(
            F.when(text.isNotNull(), F.struct(order, text.alias("text")))))
        texts = F.transform(ordered, lambda s: s["text"])
        return F.when(F.size(texts) > 0, F.array_join(texts, SEPARATOR)).alias("system")

    chunks = _normalized(df).groupBy(
        "conv_id", F.floor(F.col("turn") / _CHUNK).alias("chunk")).agg(
        joined("turn", F.when(is_system, F.col("text"))),
        F.count_if(~is_system).alias("n_turns"),
        F.coalesce(F.sum(F.when(~is_system, F.length("text"))), F.lit(0)).alias("turn_chars"))
    return chunks.groupBy("conv_id").agg(
        joined("chunk", F.col("system")), F.sum("n_turns").alias("n_turns"),
        F.sum("turn_chars").alias("turn_chars"))


def system_prompts(df: DataFrame) -> DataFrame:
    """System texts per conversation in turn order, joined by a blank line.

    Conversations without system text have no row.
    """
    return _summed(df).where(F.col("system").isNotNull()).select("conv_id", "system")


def conversation_payloads(df: DataFrame) -> DataFrame:
    """Per conversation: system text (NULL if none), number and total length of turns."""
    return _summed(df).select("conv_id", "n_turns", "turn_chars", "system")


def conversation_messages(df: DataFrame) -> DataFrame:
    """What a model is sent, one turn per row: :func:`conversation_turns` with the
    conversation's ``system`` text (NULL if none) beside each turn."""
    return conversation_turns(df).join(system_prompts(df), "conv_id", "left")
