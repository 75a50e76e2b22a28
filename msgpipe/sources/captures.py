"""Captured process output: record lines from stdout, timings from stderr."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpipe.functions import variants as V
from msgpipe.functions.answers import summary_error, summary_struct
from msgpipe.functions.checks import refuse
from msgpipe.functions.text import strip
from msgpipe.schemas import SUMMARY_RECORD
from msgpipe.sources.raw import numbered_lines

# Fixed value: the log line that carries a duration.
TIMING_PATTERN = r"summary_completed\s+message_id=(\S+)\s+.*duration_ms=(\d+)"
_WITH_ZONE = r"(?i)^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})$"


def _count_error(value: Column, name: str) -> Column:
    """Token counts are whole non-negative JSON numbers, null or absent."""
    number = F.try_variant_get(value, "$", "bigint")
    whole = F.schema_of_variant(value).isin("BIGINT", "VOID") & (F.coalesce(number, F.lit(0)) >= 0)
    return F.when(value.isNotNull() & ~whole, F.lit(f"{name} is not a count"))


def _record_error(record: Column, summary: Column) -> Column:
    """First reason why a parsed line is not a valid record, NULL if it is one."""
    texts = {name: V.member(record, name)
             for name in ("source_message_id", "model", "subject", "created_at")}
    extra = F.array_except(V.keys(record), F.array(*(F.lit(n) for n in SUMMARY_RECORD.names)))
    created = V.text(record, "created_at")
    return F.coalesce(
        F.when(record.isNull(), F.lit("malformed JSON")),
        F.when(F.size(extra) > 0, F.concat(F.lit("unknown fields: "), F.array_join(extra, ", "))),
        *(F.when(~F.coalesce(V.is_string(texts[n]), F.lit(False)) | (V.text(record, n) == ""),
                 F.lit(f"{n} must be non-empty text")) for n in ("source_message_id", "model")),
        F.when(texts["subject"].isNotNull() & ~V.is_string(texts["subject"]),
               F.lit("subject is not text")),
        F.when(summary.isNull(), F.lit("summary is missing")),
        summary_error(summary),
        *(_count_error(V.member(record, n), n) for n in ("tokens_prompt", "tokens_completion")),
        F.when(texts["created_at"].isNotNull()
               & ~F.coalesce(V.is_string(texts["created_at"]) & created.rlike(_WITH_ZONE)
                             & created.try_cast("timestamp").isNotNull(), F.lit(False)),
               F.lit("created_at is not a time with a zone")),
    )


def records_from_lines(lines: DataFrame, now: Column | None = None) -> DataFrame:
    """Record lines among (value, origin, position) rows, in the record schema.

    Lines that do not begin with a brace are ignored. A brace line that is no
    valid record makes the job fail with its place; the message quotes no content.
    """
    now = now if now is not None else F.current_timestamp()
    parsed = (
        lines.withColumn("value", strip(F.col("value")))
        .filter(F.startswith("value", F.lit("{")))
        .select("origin", "position", V.parse_whole(F.col("value")).alias("record"))
        .withColumn("answer", V.member(F.col("record"), "summary"))
    )
    record = F.col("record")
    problem = _record_error(record, F.col("answer"))
    place = F.concat("origin", F.lit(" at "), F.col("position").cast("string"), F.lit(": "))
    return refuse(parsed, F.concat(place, problem)).select(
        V.text(record, "source_message_id").alias("source_message_id"),
        F.coalesce(V.text(record, "subject"), F.lit("")).alias("subject"),
        summary_struct(F.col("answer")).alias("summary"),
        V.text(record, "model").alias("model"),
        *(F.try_variant_get("record", f"$.{n}", "bigint").alias(n)
          for n in ("tokens_prompt", "tokens_completion")),
        F.coalesce(V.text(record, "created_at").try_cast("timestamp"), now).alias("created_at"),
        "origin", "position",
    )


def read_captured_records(spark: SparkSession, path: str) -> DataFrame:
    return records_from_lines(numbered_lines(spark, path))


def timings_from_lines(lines: DataFrame) -> DataFrame:
    """(message_id, duration_ms) of the timing lines; all other lines are ignored."""
    return lines.filter(F.col("value").rlike(TIMING_PATTERN)).select(
        F.regexp_extract("value", TIMING_PATTERN, 1).alias("message_id"),
        F.regexp_extract("value", TIMING_PATTERN, 2).cast("bigint").alias("duration_ms"),
    )


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    return timings_from_lines(spark.read.text(path))
