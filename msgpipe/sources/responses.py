"""Prepared answers as rows of (message_id, answer JSON text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from msgpipe.functions import variants as V
from msgpipe.session import stage


def read_response_object(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object {message_id: answer} per file, for small hand-made sets.

    Anything but an object makes the job fail with the path. The whole object is
    one value; :func:`read_large_response_object` reads larger ones.
    """
    files = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("origin"))
    value = V.parse_whole(F.col("value"))
    checked = F.when(value.isNull(), F.raise_error(F.concat("origin", F.lit(": invalid JSON")))) \
        .when(~V.is_object(value), F.raise_error(
            F.concat("origin", F.lit(": expected a top-level JSON object")))) \
        .otherwise(value)
    members = files.select(
        F.explode(F.try_variant_get(checked, "$", "map<string,variant>"))
        .alias("message_id", "answer"))
    return members.select("message_id", F.to_json("answer").alias("answer"))


def read_large_response_object(spark: SparkSession, path: str) -> DataFrame:
    """:func:`read_response_object` for objects of any size, read in splits.

    The text is cut at its commas, wherever they are, by Spark's own line reader. Quotes
    before a piece say whether it starts within a string, brackets before it how deep it
    lies; both are running sums, per split first, then over splits. A comma outside of strings at
    depth one ends a member, and the pieces of a member are put together again. Only one
    answer is ever held as one value.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    pieces = stage(spark.read.option("lineSep", ",").text(path).select(
        "value", F.col("_metadata.file_path").alias("origin"),
        F.col("_metadata.file_block_start").alias("split"), row.alias("row"))
        .withColumn("bare", F.regexp_replace("value", r"(?s)\\.", "")), "pieces")
    quotes = F.length("bare") - F.length(F.replace("bare", F.lit('"'), F.lit("")))
    quoted = _summed(pieces.withColumn("quotes", quotes), "quotes")
    starts_in = F.col("quotes_before") % 2 == 1
    ends_in = (F.col("quotes_before") + F.col("quotes")) % 2 == 1
    # Strings that begin or end beyond the piece are closed for the count of brackets.
    closed = F.concat(F.when(starts_in, F.lit('"')).otherwise(F.lit("")), "bare",
                      F.when(ends_in, F.lit('"')).otherwise(F.lit("")))
    brackets = F.regexp_replace(closed, '"[^"]*"', "")
    depth = (F.regexp_count(brackets, F.lit(r"[\[{]")) - F.regexp_count(brackets, F.lit(r"[\]}]")))
    deep = _summed(quoted.withColumns({"open": ends_in, "depth": depth}).drop(
        "quotes", "quotes_before", "bare"), "depth")
    ended = ~F.col("open") & (F.col("depth_before") + F.col("depth") == 1)
    members = _summed(deep.withColumn("ends", ended.cast("bigint")), "ends")
    texts = members.groupBy("origin", F.col("ends_before").alias("number")).agg(
        F.array_sort(F.collect_list(F.struct("split", "row", "value"))).alias("p"),
        F.max("open").alias("open"))
    text = F.array_join(F.transform("p", lambda x: x["value"]), ",")
    count = texts.groupBy("origin").agg(F.max("number").alias("last"))
    whole = texts.join(count, "origin").select("origin", "number", "last", F.concat(
        F.when(F.col("number") == 0, F.lit("")).otherwise(F.lit("{")), text,
        F.when(F.col("number") == F.col("last"), F.lit("")).otherwise(F.lit("}"))).alias("value"))
    value = V.parse_whole(F.col("value"))
    items = F.try_variant_get(value, "$", "map<string,variant>")
    checked = F.when(value.isNull(), F.raise_error(F.concat("origin", F.lit(": invalid JSON")))) \
        .when(items.isNull(), F.raise_error(
            F.concat("origin", F.lit(": expected a top-level JSON object")))) \
        .when((F.size(items) != 1) & (F.col("last") > 0), F.raise_error(
            F.concat("origin", F.lit(": invalid JSON")))) \
        .otherwise(items)
    return whole.select(F.explode(checked).alias("message_id", "answer")).select(
        "message_id", F.to_json("answer").alias("answer"))


def _summed(pieces: DataFrame, column: str) -> DataFrame:
    """``<column>_before``: the column's sum over all pieces of the file before this one.

    Summed per split, where pieces are in order; what earlier splits add up to is one row
    per split.
    """
    within = (W.partitionBy("origin", "split").orderBy("row")
              .rowsBetween(W.unboundedPreceding, -1))
    over = W.partitionBy("origin").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    splits = pieces.groupBy("origin", "split").agg(F.sum(column).alias("all")).select(
        "origin", "split", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("earlier"))
    before = F.coalesce(F.sum(column).over(within), F.lit(0)) + F.col("earlier")
    return pieces.join(splits, ["origin", "split"]).withColumn(f"{column}_before", before).drop(
        "earlier")


def read_response_lines(spark: SparkSession, path: str) -> DataFrame:
    """One {"message_id": ..., "answer": {...}} per line, splittable."""
    value = V.parse_whole(F.col("value"))
    return spark.read.text(path).filter(F.trim("value") != "").select(
        V.text(value, "message_id").alias("message_id"),
        F.to_json(V.member(value, "answer")).alias("answer"),
    )


def read_response_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("message_id", "answer")
