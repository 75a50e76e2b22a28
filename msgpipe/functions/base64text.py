"""Base64url bodies to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgpipe.functions.text import let

_ASCII = r"^\p{ASCII}*+\z"


def _state(kept: Column, place: Column, pads: Column, done: Column) -> Column:
    return F.struct(kept.alias("kept"), place.alias("place"), pads.alias("pads"),
                    done.alias("done"))


def _read_segment(state: Column, segment: Column) -> Column:
    """Take one run of letters and the pad that follows it.

    ``place`` is the position within a group of four letters. A pad counts only
    from the third place on; one that fills the group ends the data.
    """
    place = ((state["place"] + F.length(segment)) % 4).cast("int")
    pads = (F.when(F.length(segment) > 0, 0).otherwise(state["pads"])
            + F.when(place >= 2, 1).otherwise(0)).cast("int")
    return F.when(state["done"], state).otherwise(
        _state(F.concat(state["kept"], segment), place, pads,
               (place >= 2) & (place + pads >= 4)))


def _lenient(letters: Column, padding: Column) -> Column:
    """Struct (letters, ok) for input with line breaks, junk or inner pads."""
    clean = F.regexp_replace(F.concat(letters, padding), "[^A-Za-z0-9+/=]", "")
    # The last segment has no pad behind it, so it is added to the running state
    # without one.
    parts = F.split(clean, "=")
    start = _state(F.lit(""), F.lit(0), F.lit(0), F.lit(False))
    read = F.reduce(F.slice(parts, F.lit(1), F.size(parts) - 1), start, _read_segment)
    tail = F.try_element_at(parts, F.lit(-1))
    return let(read, lambda s: F.when(
        s["done"], F.struct(s["kept"].alias("letters"), F.lit(True).alias("ok"))
    ).otherwise(F.struct(
        F.concat(s["kept"], tail).alias("letters"),
        (((s["place"] + F.length(tail)) % 4) == 0).alias("ok"),
    )))


def _standard(data: Column) -> Column:
    """The url-safe letters replaced by the standard ones."""
    return F.replace(F.replace(data, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))


def _text(binary: Column) -> Column:
    return F.make_valid_utf8(binary.cast("string"))


def _result(text: Column | None, error: Column | None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct((nothing if text is None else text).alias("text"),
                    (nothing if error is None else error).alias("error"))


def _decoded(data: Column, letters: Column) -> Column:
    """Clean data in one pass; whatever that refuses letter by letter.

    The strict decoder skips white space, which shows in a result shorter than
    the letters call for.
    """
    padding = F.repeat(F.lit("="), F.pmod(-F.length(data), F.lit(4)).cast("int"))
    strict = F.try_to_binary(F.concat(letters, padding), F.lit("base64"))
    full_length = F.floor(F.length(F.replace(letters, F.lit("="), F.lit(""))) * 3 / 4)
    lenient = let(_lenient(letters, padding), lambda p: F.when(
        p["ok"], _result(_text(F.unbase64(p["letters"])), None),
    ).otherwise(_result(None, F.lit("body data has incorrect base64 padding"))))
    return let(strict, lambda binary: (
        F.when(binary.isNotNull() & (F.octet_length(binary) == full_length),
               _result(_text(binary), None))
        .when(letters.rlike(_ASCII), lenient)
        .otherwise(_result(None, F.lit("body data contains non-ASCII characters")))
    ))


def decode_base64url(data: Column) -> Column:
    """Struct (text, error): the decoded text, or why ``data`` is not base64.

    Both alphabets are read, missing padding is added, other ASCII characters
    are skipped, and invalid UTF-8 becomes U+FFFD. Nothing throws.
    """
    return let(data, lambda d: F.when(d.isNotNull(), let(_standard(d), lambda s: _decoded(d, s))))
