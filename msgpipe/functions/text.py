"""Small text helpers shared by the other column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a text strip removes at both ends (Unicode white
# space plus the ASCII information separators).
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# The characters that end a line.
LINE_BREAK_CLASS = "[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times in ``body``.

    Catalyst would otherwise evaluate a higher-order expression as often as it
    is mentioned.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Remove white space at both ends, Unicode spaces included."""
    return F.trim(text, F.lit(SPACE_CHARS))


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters plus ``...``; NULL stays NULL."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def error_text(message: Column, fallback: str) -> Column:
    """A message that is never NULL or empty."""
    return F.coalesce(F.nullif(message, F.lit("")), F.lit(fallback))


def iso_utc(ts: Column) -> Column:
    """Timestamp as ISO text with a ``Z`` suffix (session time zone UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
