"""Records, dead letters and the split between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgpipe.functions.text import iso_utc
from msgpipe.schemas import (
    DEAD_LETTER,
    STORED_RECORD,
    SUMMARY,
    SUMMARY_RECORD,
    error_struct,
    first_error,
)


def assemble_records(df: DataFrame, model: str, now: Column,
                     keep: Sequence[str] = ()) -> DataFrame:
    """Validated answers to summary records, errors carried along.

    Needs message_id, subject (already redacted), a validated summary and err.
    Missing token columns mean usage was never observed, a missing duration that no
    call was timed. An empty id or a negative count is a ``summarize`` error.
    ``keep`` names columns to carry along.
    """
    if not model:
        raise ValueError("model must not be empty")

    def number(name: str) -> Column:
        value = F.col(name) if name in df.columns else F.lit(None)
        return value.cast("bigint").alias(name)

    records = df.select(
        F.col("message_id").alias("source_message_id"), "subject", "summary",
        F.lit(model).alias("model"), number("tokens_prompt"), number("tokens_completion"),
        now.alias("created_at"), number("duration_ms"), "err", *keep,
    )
    problem = (
        F.when(F.coalesce("source_message_id", F.lit("")) == "",
               F.lit("source_message_id must not be empty"))
        .when((F.col("tokens_prompt") < 0) | (F.col("tokens_completion") < 0),
              F.lit("token counts must not be negative"))
    )
    return records.withColumn(
        "err", first_error(F.col("err"), error_struct("summarize", problem)))


def records_of(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The success branch."""
    return df.filter(F.col("err").isNull()).select(*SUMMARY_RECORD.names, *keep)


def dead_letters_of(df: DataFrame, now: Column, *, stage_mode: str = "true",
                    id_column: str = "source_message_id") -> DataFrame:
    """The failure branch, in the dead-letter schema.

    ``stage_mode='true'`` records the stage that failed; ``'batch'`` files every
    failure under ``summarize``, as a loop with one guard around it would.
    """
    if stage_mode not in ("true", "batch"):
        raise ValueError(f"unknown stage_mode {stage_mode!r}")
    stage = F.col("err.stage") if stage_mode == "true" else F.lit("summarize")
    columns = {
        "source_message_id": F.col(id_column),
        "stage": stage,
        "error": F.coalesce(F.nullif("err.error", F.lit("")), F.lit("unknown error")),
        "traceback": F.coalesce("err.traceback", F.lit("")),
        "failed_at": now,
    }
    return df.filter(F.col("err").isNotNull()).select(
        *(columns[n].alias(n) for n in DEAD_LETTER.names))


def split(df: DataFrame, now: Column, *, stage_mode: str = "true",
          keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(records, dead letters); every row is in exactly one of them.

    Pass a staged table: both branches read ``df``.
    """
    return records_of(df, keep), dead_letters_of(df, now, stage_mode=stage_mode)


def flatten_records(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Nested records to the stored columns; ``keep`` names columns to carry along."""
    return records.select(*(
        F.col(f"summary.{n}" if n in SUMMARY.names else n).alias(n)
        for n in STORED_RECORD.names), *keep)


def unflatten_records(stored: DataFrame) -> DataFrame:
    """Stored columns back to nested records."""
    return stored.select(*(
        F.struct(*SUMMARY.names).alias(n) if n == "summary" else F.col(n)
        for n in SUMMARY_RECORD.names))


def list_columns_as_json(stored: DataFrame) -> DataFrame:
    """Stored records with the two lists as JSON text and the time as ISO text."""
    return stored.withColumns({
        "key_points": F.to_json("key_points"),
        "action_items": F.to_json("action_items"),
        "created_at": iso_utc(F.col("created_at")),
    })


def record_json_column(*, pretty: bool = False) -> Column:
    """A record as JSON text, NULL token counts written out."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    return F.to_json(F.struct(*(
        iso_utc(F.col(n)).alias(n) if n == "created_at" else F.col(n)
        for n in SUMMARY_RECORD.names)), options)


def record_json(records: DataFrame) -> DataFrame:
    return records.select(record_json_column().alias("value"))
