"""Strict validation of a structured answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgpipe.functions import variants as V
from msgpipe.functions.text import truncate
from msgpipe.schemas import SUMMARY

# Fixed value: how much of an invalid answer an error may quote.
RAW_QUOTE_CHARS = 200

_TEXT_FIELDS = ("tl_dr", "summary", "category")
_LIST_FIELDS = ("key_points", "action_items")


def _text_error(value: Column, name: str) -> Column:
    return (
        F.when(value.isNull(), F.lit(f"{name} is missing"))
        .when(~V.is_string(value), F.lit(f"{name} is not text"))
        .when(F.try_variant_get(value, "$", "string") == "", F.lit(f"{name} is empty"))
    )


def summary_error(value: Column) -> Column:
    """Why a VARIANT is not a summary, NULL if it is one. Mention a column, not an expression.

    No type is coerced and no unknown field is accepted. Lists may be absent;
    nothing may be null.
    """
    extra = F.array_except(V.keys(value), F.array(*(F.lit(name) for name in SUMMARY.names)))
    return F.coalesce(
        F.when(~V.is_object(value), F.lit("not a JSON object")),
        F.when(F.size(extra) > 0,
               F.concat(F.lit("unknown fields: "), F.array_join(F.array_sort(extra), ", "))),
        *(_text_error(V.member(value, name), name) for name in _TEXT_FIELDS),
        *(V.string_list_error(V.member(value, name), name) for name in _LIST_FIELDS),
    )


def answer_error(answer: Column, value: Column) -> Column:
    """Why an answer is not a summary, with a bounded quote of it.

    ``value`` is ``try_parse_json(answer)``; a repeated key makes the JSON invalid.
    """
    reason = F.coalesce(F.when(value.isNull(), F.lit("invalid JSON")), summary_error(value))
    return F.concat(
        F.lit("no valid summary: "), reason,
        F.lit("; raw_output='"), F.coalesce(truncate(answer, RAW_QUOTE_CHARS), F.lit("")),
        F.lit("'"))


def summary_struct(value: Column) -> Column:
    """A validated answer (VARIANT) as the summary struct; absent lists are empty."""
    no_items = F.array().cast("array<string>")
    fields = {
        **{n: V.text(value, n) for n in _TEXT_FIELDS},
        **{n: F.coalesce(F.try_variant_get(value, f"$.{n}", "array<string>"), no_items)
           for n in _LIST_FIELDS},
    }
    return F.struct(*(fields[n].alias(n) for n in SUMMARY.names))
