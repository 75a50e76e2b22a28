"""The prompt for one message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the instruction every prompt begins with.
INSTRUCTION = (
    "Read the email below and return a JSON object with these keys: "
    "tl_dr (one sentence), summary (2-4 sentences), key_points (list), "
    "action_items (list), category (single lowercase word)."
)


def render_prompt(subject: Column, sender: Column, body: Column) -> Column:
    """Instruction, a blank line, then Subject, From and Body."""
    return F.concat(
        F.lit(INSTRUCTION), F.lit("\n\nSubject: "), subject,
        F.lit("\nFrom: "), sender, F.lit("\nBody:\n"), body,
    )
