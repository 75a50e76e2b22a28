"""Latency totals and breaches of the service-level targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A message may take 20 s, a batch 2 minutes.
MESSAGE_TARGET_MS = 20_000
BATCH_TARGET_MS = 120_000
# The wording of a breach, with the target filled in first.
MESSAGE_BREACH = "NFR-P1 breach: message_id=%s took %d ms (> {} ms per-email budget)"
BATCH_BREACH = "NFR-P2 breach: batch total %d ms (> {} ms batch budget)"


def timing_summary(timings: DataFrame) -> DataFrame:
    """One row: messages, total and slowest milliseconds; zeros for no timings."""
    return timings.agg(
        F.count(F.lit(1)).alias("messages"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms"),
        F.coalesce(F.max("duration_ms"), F.lit(0)).alias("slowest_ms"),
    )


def slowest_message(timings: DataFrame) -> DataFrame:
    """The slowest message (smallest id among equals) and its milliseconds."""
    return (timings.select("message_id", "duration_ms")
            .orderBy(F.col("duration_ms").desc(), "message_id").limit(1))


def slo_breaches(timings: DataFrame, message_target_ms: int = MESSAGE_TARGET_MS,
                 batch_target_ms: int = BATCH_TARGET_MS) -> DataFrame:
    """One row per breach (target, message_id, duration_ms, breach text).

    A breach is strictly above its target; the batch row has no message id.
    """
    per_message = timings.filter(F.col("duration_ms") > message_target_ms).select(
        F.lit("NFR-P1").alias("target"), "message_id", "duration_ms",
        F.format_string(MESSAGE_BREACH.format(message_target_ms), "message_id", "duration_ms")
        .alias("breach"))
    batch = (
        timings.agg(F.sum("duration_ms").alias("duration_ms"))
        .filter(F.col("duration_ms") > batch_target_ms)
        .select(
            F.lit("NFR-P2").alias("target"), F.lit(None).cast("string").alias("message_id"),
            "duration_ms",
            F.format_string(BATCH_BREACH.format(batch_target_ms), "duration_ms").alias("breach"))
    )
    return per_message.unionByName(batch)
