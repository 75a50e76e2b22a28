"""Raw resources to parsed messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgpipe.functions import mime
from msgpipe.functions import variants as V
from msgpipe.functions.addresses import addresses
from msgpipe.functions.dates import epoch_millis, millis_error, millis_to_timestamp
from msgpipe.functions.headers import HEADERS_TYPE, header_or_empty
from msgpipe.functions.html import html_error, html_to_text
from msgpipe.schemas import EMAIL_MESSAGE, carried_error, error_struct, first_error


def _optional_text_error(value: Column, name: str) -> Column:
    return F.when(V.present(value) & ~V.is_string(value), F.lit(f"{name} is not text"))


def _headers_error(tree: Column) -> Column:
    """Headers must be a list of objects; a counted entry needs text on both sides."""
    headers = V.member(tree, "headers")
    entries = F.try_variant_get(headers, "$", "array<variant>")

    def malformed(entry: Column) -> Column:
        name, value = V.member(entry, "name"), V.member(entry, "value")
        return F.when(name.isNull() & value.isNull(), ~V.is_object(entry)).otherwise(
            name.isNotNull() & value.isNotNull() & ~V.is_string(name))

    def unusable(entry: Column) -> Column:
        value = V.member(entry, "value")
        return value.isNotNull() & ~V.is_string(value) & F.coalesce(
            F.lower(V.text(entry, "name")).isin("subject", "from", "to"), F.lit(False))

    return (
        F.when(headers.isNotNull() & entries.isNull(), F.lit("headers is not a list"))
        .when(F.exists(entries, malformed), F.lit("headers has a malformed entry"))
        .when(F.exists(entries, unusable), F.lit("a header value is not text"))
    )


def _labels_error(labels: Column) -> Column:
    return F.when(F.is_variant_null(labels), F.lit("labelIds is null")).otherwise(
        V.string_list_error(labels, "labelIds"))


def _date_text(date: Column) -> Column:
    """internalDate as text; a JSON number or boolean counts by its whole part."""
    return F.when(V.is_string(date), F.try_variant_get(date, "$", "string")).otherwise(
        F.coalesce(F.try_variant_get(date, "$", "bigint").cast("string"), F.to_json(date)))


def parse_messages(raw: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
    """Parsed message columns plus ``err``; a bad row keeps its id and carries the reason.

    All parsing stays in the JVM. ``keep`` names columns of ``raw`` to carry along.

    Each step takes apart what the one before found and passes on only what is
    still needed, so large bodies are neither copied nor parsed again.
    """
    carried = ["message_id", "err", *keep]
    resource = F.col("payload")
    members = raw.select(
        "message_id", carried_error(raw).alias("err"), *keep,
        *(V.member(resource, name).alias(column) for name, column in (
            ("id", "id"), ("threadId", "thread"), ("snippet", "snip"), ("labelIds", "label_ids"),
            ("internalDate", "date"), ("payload", "tree"))),
        # Anything with one of the mandatory members is an object.
        F.when(V.member(resource, "id").isNull() & V.member(resource, "internalDate").isNull()
               & ~V.is_object(resource), F.lit("resource is not a JSON object"))
        .alias("resource_error"),
    )
    trees = members.select(
        *carried, "id", "thread", "snip", "label_ids", "date", "resource_error",
        _date_text(F.col("date")).alias("date_text"),
        mime.flatten_parts(F.col("tree")).alias("parts"),
        F.try_variant_get("tree", "$.headers", HEADERS_TYPE).alias("headers"),
        _headers_error(F.col("tree")).alias("headers_error"),
    )
    texts = trees.withColumns({
        "plain": mime.inline_text(F.col("parts"), "text/plain"),
        "millis": epoch_millis(F.col("date_text")),
    })
    found = texts.withColumns({
        "html": F.when(F.col("plain.text") == "",
                       mime.inline_text(F.col("parts"), "text/html")),
        "files": mime.attachment_names(F.col("parts")),
        "parts_error": mime.parts_error(F.col("parts")),
    }).drop("parts")
    problem = F.coalesce(
        "resource_error",
        "headers_error",
        F.when(F.col("id").isNull(), F.lit("id is missing")),
        F.when(~V.is_string(F.col("id")) | (F.try_variant_get("id", "$", "string") == ""),
               F.lit("id is not a non-empty text")),
        _optional_text_error(F.col("thread"), "threadId"),
        _labels_error(F.col("label_ids")),
        F.when(F.col("date").isNull(), F.lit("internalDate is missing")),
        millis_error(F.col("date_text"), F.col("millis")),
        "parts_error",
        F.col("plain.error"),
        F.col("html.error"),
        html_error(F.col("html.text")),
        _optional_text_error(F.col("snip"), "snippet"),
    )
    judged = found.withColumn("err", first_error(F.col("err"), error_struct("parse", problem)))
    ok = F.col("err").isNull()
    page = F.when(ok, F.nullif(F.col("html.text"), F.lit("")))
    to_header = F.when(ok, header_or_empty(F.col("headers"), "to"))
    converted = judged.withColumns({
        "recipients": addresses(to_header),
        "page_text": F.when(page.isNotNull(), html_to_text(page)),
    })
    empty = F.array().cast("array<string>")
    columns = {
        "message_id": F.coalesce("message_id", F.try_variant_get("id", "$", "string")),
        "thread_id": F.try_variant_get("thread", "$", "string"),
        "subject": header_or_empty(F.col("headers"), "subject"),
        "sender": header_or_empty(F.col("headers"), "from"),
        "recipients": F.col("recipients"),
        "labels": F.coalesce(F.try_variant_get("label_ids", "$", "array<string>"), empty),
        "received_at": millis_to_timestamp(F.col("millis")),
        "body_text": F.coalesce(F.nullif(F.col("plain.text"), F.lit("")), "page_text",
                                F.lit("")),
        "snippet": F.try_variant_get("snip", "$", "string"),
        "attachment_filenames": F.col("files"),
    }
    return converted.select(
        columns["message_id"].alias("message_id"),
        *(F.when(ok, columns[name]).alias(name)
          for name in EMAIL_MESSAGE.names if name != "message_id"),
        "err", *keep,
    )
