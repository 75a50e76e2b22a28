"""Type-aware access to VARIANT values, where JSON types matter."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


# Closes the array that a text is parsed in. A text cannot know it, so it cannot end the
# array itself and pass for one value.
_MARK = uuid.uuid4().hex

# try_parse_json refuses a string of more characters than this as malformed, and has no option
# for it. from_json has; its other options make it read what try_parse_json reads.
_LONGEST = 20_000_000
_AS_LONG_AS_IT_IS = {"maxStringLen": str(2**31 - 1), "allowSingleQuotes": "false",
                     "allowNonNumericNumbers": "false"}


def parse(text: Column) -> Column:
    """``try_parse_json`` for texts of any length that a VARIANT can hold (128 MB)."""
    return F.when(F.octet_length(text) > _LONGEST,
                  F.from_json(text, "variant", _AS_LONG_AS_IT_IS)).otherwise(F.try_parse_json(text))


def parse_whole(text: Column) -> Column:
    """The one JSON value that a text consists of as VARIANT, NULL for anything else.

    :func:`parse` reads one value and ignores what follows. In an array behind the
    text, a mark must be the second item: trailing text breaks the array, and a second
    value or a comma moves the mark.
    """
    items = F.try_variant_get(parse(F.concat(
        F.lit("["), text, F.lit(f',"{_MARK}"]'))), "$", "array<variant>")
    marked = F.try_variant_get(F.get(items, 1), "$", "string") == _MARK
    return F.when((F.size(items) == 2) & marked, F.get(items, 0))


def member(value: Column, name: str) -> Column:
    """Member of an object as VARIANT; SQL NULL when absent, JSON null kept."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def text(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "string")


def present(value: Column) -> Column:
    """True when the member exists and is not JSON null."""
    return value.isNotNull() & ~F.is_variant_null(value)


def is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def is_object(value: Column) -> Column:
    """Object test that looks at one level only, whatever hangs below it."""
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def keys(value: Column) -> Column:
    """Member names of an object, NULL for anything else."""
    return F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))


def truthy(value: Column) -> Column:
    """Neither absent, null, false, zero nor empty."""
    return present(value) & ~F.to_json(value).isin('""', "0", "0.0", "-0.0", "false", "[]", "{}")


def string_list_error(value: Column, name: str) -> Column:
    """NULL if ``value`` is absent or a list of strings, else a message."""
    kind = F.schema_of_variant(value)
    items = F.try_variant_get(value, "$", "array<string>")
    good = kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(items, lambda x: x.isNull())
    return F.when(value.isNotNull() & ~F.coalesce(good, F.lit(False)),
                  F.lit(f"{name} is not a list of strings"))
