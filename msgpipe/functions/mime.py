"""The MIME tree of a message as a flat, ordered array of parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgpipe.functions import variants as V
from msgpipe.functions.base64text import decode_base64url
from msgpipe.functions.text import let, strip

# Levels unrolled for every message. Deeper trees are rare and go on level by
# level, as many times as the tree names its parts.
_COMMON_LEVELS = 3


def _node(value: Column, opened: bool) -> Column:
    return F.struct(value.alias("value"), F.lit(opened).alias("opened"))


def _open_level(nodes: Column) -> Column:
    """Put the children of every unopened node right behind it."""
    no_parts = F.array().cast("array<variant>")
    return F.flatten(F.transform(nodes, lambda n: F.when(n["opened"], F.array(n)).otherwise(
        F.concat(
            F.array(_node(n["value"], True)),
            F.transform(
                F.coalesce(F.try_variant_get(n["value"], "$.parts", "array<variant>"), no_parts),
                lambda child: _node(child, False),
            ),
        ))))


def _pending(nodes: Column) -> Column:
    return F.exists(nodes, lambda n: ~n["opened"])


def _walk(root: Column) -> Column:
    """All nodes of the tree in pre-order."""
    shallow = reduce(lambda nodes, _: _open_level(nodes), range(_COMMON_LEVELS),
                     F.array(_node(root, False)))
    levels = F.regexp_count(F.to_json(root), F.lit('"parts"')) + 1
    return let(shallow, lambda nodes: F.when(_pending(nodes), F.reduce(
        F.sequence(F.lit(1), levels), nodes,
        lambda acc, _: F.when(_pending(acc), _open_level(acc)).otherwise(acc),
    )).otherwise(nodes))


def _part(node: Column) -> Column:
    """The members of a part the jobs use, and what is wrong with them.

    A value with any of these members is an object; only one without them is
    looked at as a whole.
    """
    value = node["value"]
    mime_type, filename, body, data, parts = (
        V.member(value, name) for name in ("mimeType", "filename", "body", "body.data", "parts"))
    bare = mime_type.isNull() & filename.isNull() & body.isNull() & parts.isNull()
    error = (
        F.when(bare & ~V.is_object(value), F.lit("part is not an object"))
        .when(~V.is_string(filename) & V.truthy(filename), F.lit("filename is not text"))
        .when(F.try_variant_get(parts, "$", "array<variant>").isNull() & V.truthy(parts),
              F.lit("parts is not a list"))
    )
    body_error = (
        F.when(data.isNull() & ~V.is_object(body) & V.truthy(body),
               F.lit("body is not an object"))
        .when(~V.is_string(data) & V.truthy(data), F.lit("body data is not text"))
    )
    return F.struct(
        V.text(value, "mimeType").alias("mime_type"),
        F.nullif(F.when(V.is_string(filename), V.text(value, "filename")), F.lit(""))
        .alias("filename"),
        F.nullif(F.when(V.is_string(data), V.text(value, "body.data")), F.lit("")).alias("data"),
        error.alias("error"),
        body_error.alias("body_error"),
    )


def flatten_parts(payload: Column) -> Column:
    """Parts in pre-order, root first, to any depth: mime_type, filename, data, errors.

    Empty file names and empty data are NULL. A missing or empty payload is one
    empty part.
    """
    counts = (V.member(payload, "mimeType").isNotNull() | V.member(payload, "parts").isNotNull()
              | V.truthy(payload))
    root = F.when(counts, payload).otherwise(F.parse_json(F.lit("{}")))
    return F.transform(_walk(root), _part)


def parts_error(parts: Column) -> Column:
    """First structural error among the parts, NULL if there is none."""
    return F.try_element_at(F.filter(F.transform(parts, lambda p: p["error"]),
                                     lambda e: e.isNotNull()), F.lit(1))


def attachment_names(parts: Column) -> Column:
    named = F.filter(parts, lambda p: p["filename"].isNotNull())
    return F.transform(named, lambda p: p["filename"])


def inline_text(parts: Column, mime_type: str) -> Column:
    """Struct (text, error): stripped text of the inline parts of one type."""
    inline = F.filter(
        parts, lambda p: (p["mime_type"] == mime_type) & p["filename"].isNull()
    )
    decoded = F.transform(inline, lambda p: F.when(
        p["body_error"].isNotNull(),
        F.struct(F.lit(None).cast("string").alias("text"), p["body_error"].alias("error")),
    ).otherwise(decode_base64url(p["data"])))
    return let(decoded, lambda pieces: F.struct(
        strip(F.array_join(F.transform(pieces, lambda d: d["text"]), "\n")).alias("text"),
        F.try_element_at(F.filter(F.transform(pieces, lambda d: d["error"]),
                                  lambda e: e.isNotNull()), F.lit(1)).alias("error"),
    ))
