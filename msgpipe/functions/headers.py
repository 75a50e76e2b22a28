"""Header lookup in an array of (name, value) structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADERS_TYPE = "array<struct<name:string,value:string>>"


def header(headers: Column, name: str) -> Column:
    """Value of a header, name in any case, last one wins; NULL when absent.

    Entries without a name or a value do not count.
    """
    wanted = name.lower()
    hits = F.filter(
        headers, lambda h: (F.lower(h["name"]) == wanted) & h["value"].isNotNull()
    )
    return F.try_element_at(hits, F.lit(-1))["value"]


def header_or_empty(headers: Column, name: str) -> Column:
    return F.coalesce(header(headers, name), F.lit(""))
