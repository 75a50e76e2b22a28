"""Masking of personal data by an ordered, extensible list of rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RedactionRule:
    """Replace every match of ``pattern`` (Java syntax) by ``replacement``.

    ``required`` names a literal every match contains; rows without it skip the
    regular expression.
    """

    pattern: str
    replacement: str
    required: str | None = None


# The placeholder and the characters of an e-mail address.
EMAIL_PLACEHOLDER = "[scrubbed]@example.com"
EMAIL_LOCAL_CHARS = "A-Za-z0-9._%+-"
EMAIL_DOMAIN = r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

# A match may only begin where a run of local characters begins, or where the
# previous match ended. That is where a leftmost match begins anyway; saying so
# keeps the scan linear on long runs such as embedded base64.
EMAIL_RULE = RedactionRule(
    pattern=rf"(?:\G|(?<![{EMAIL_LOCAL_CHARS}]))[{EMAIL_LOCAL_CHARS}]++@{EMAIL_DOMAIN}",
    replacement=EMAIL_PLACEHOLDER,
    required="@",
)
DEFAULT_RULES: tuple[RedactionRule, ...] = (EMAIL_RULE,)


def redact(text: Column, rules: Sequence[RedactionRule] = DEFAULT_RULES) -> Column:
    """Apply the rules in order. NULL stays NULL."""
    for rule in rules:
        masked = F.regexp_replace(text, F.lit(rule.pattern), F.lit(rule.replacement))
        if rule.required is not None:
            masked = F.when(F.contains(text, F.lit(rule.required)), masked).otherwise(text)
        text = masked
    return text


def redact_list(values: Column, rules: Sequence[RedactionRule] = DEFAULT_RULES) -> Column:
    return F.transform(values, lambda value: redact(value, rules))


def redact_message(df: DataFrame, rules: Sequence[RedactionRule] = DEFAULT_RULES) -> DataFrame:
    """Input side: mask the text fields of a message before anything answers it.

    Ids, labels, date and attachment names carry no free text and stay.
    """
    return df.withColumns({
        "subject": redact(F.col("subject"), rules),
        "sender": redact(F.col("sender"), rules),
        "recipients": redact_list(F.col("recipients"), rules),
        "body_text": redact(F.col("body_text"), rules),
        "snippet": redact(F.col("snippet"), rules),
    })


def redact_record(df: DataFrame, rules: Sequence[RedactionRule] = DEFAULT_RULES) -> DataFrame:
    """Output side: mask subject and every field of the summary; provenance stays."""
    summary = F.col("summary")
    for field in ("tl_dr", "summary", "category"):
        summary = summary.withField(field, redact(F.col(f"summary.{field}"), rules))
    for field in ("key_points", "action_items"):
        summary = summary.withField(field, redact_list(F.col(f"summary.{field}"), rules))
    return df.withColumns({"subject": redact(F.col("subject"), rules), "summary": summary})
