"""Message content blocks and message lists of a model call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgpipe.functions import variants as V


def content_text(content: Column) -> Column:
    """Content (VARIANT) as text: NULL is '', text stays, a list gives its text blocks."""
    blocks = F.filter(
        F.try_variant_get(content, "$", "array<variant>"),
        lambda b: F.coalesce(V.text(b, "type") == "text", F.lit(False)),
    )
    return (
        F.when(~V.present(content), F.lit(""))
        .when(V.is_string(content), F.try_variant_get(content, "$", "string"))
        .otherwise(F.coalesce(F.array_join(
            F.transform(blocks, lambda b: F.coalesce(V.text(b, "text"), F.lit(""))), ""),
            F.lit("")))
    )


def assemble_messages(messages: Column) -> Column:
    """A call's messages (VARIANT) as struct (system, turns).

    A bare string is one user turn. System texts are joined by a blank line,
    NULL if there are none; the other turns keep their order, a missing role
    means user.
    """
    items = F.transform(
        F.coalesce(F.try_variant_get(messages, "$", "array<variant>"),
                   F.array().cast("array<variant>")),
        lambda m: F.struct(
            F.coalesce(V.text(m, "role"), F.lit("user")).alias("role"),
            content_text(V.member(m, "content")).alias("text")),
    )
    bare = F.array(F.struct(F.lit("user").alias("role"),
                            F.try_variant_get(messages, "$", "string").alias("text")))
    system = F.transform(F.filter(items, lambda m: m["role"] == "system"), lambda m: m["text"])
    turns = F.filter(items, lambda m: m["role"] != "system")
    text_only = F.coalesce(V.is_string(messages), F.lit(False))
    return F.struct(
        F.when(~text_only & (F.size(system) > 0), F.array_join(system, "\n\n")).alias("system"),
        F.when(text_only, bare).otherwise(turns).alias("turns"),
    )
