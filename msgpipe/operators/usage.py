"""Token usage and run totals. NULL means "never observed" and is not zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from msgpipe.session import stage

METRICS = ("tokens_prompt", "tokens_completion")
# Steps of a message that one window sums up; see running_usage.
BLOCK_STEPS = 10_000


def token_usage(calls: DataFrame, key: str = "message_id") -> DataFrame:
    """Sum per message over its calls; each metric stays NULL until one call reports it."""
    return calls.groupBy(key).agg(*(F.sum(m).alias(m) for m in METRICS))


def running_usage(calls: DataFrame, key: str = "message_id", step: str = "step",
                  tie_break: Sequence[str] = (), block_steps: int = BLOCK_STEPS) -> DataFrame:
    """Running token totals after every step of a message; equal steps in any order.

    Messages of up to ``block_steps`` steps take one window each. Longer ones, if a count of
    the keys finds any, are dealt to ranges of their steps, equal and NULL steps too, so that
    a message of any length is spread over many tasks; a range starts from the sums of the ranges
    before it, one row per message and range.
    """
    sizes = calls.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_steps)
    total = sizes.agg(F.sum("n")).first()[0]
    if total is None:
        return _running(calls, [key], [step, *tie_break])
    longest = sizes.select(F.col(key).alias("long_key"))
    is_long = F.col(key).eqNullSafe(F.col("long_key"))
    short = calls.join(longest, is_long, "left_anti")
    # A place tells equal steps apart; staged, since neither it nor the ranges would come out
    # the same twice.
    order = [step, *tie_break, "place"]
    ranges = stage(
        calls.join(longest, is_long, "left_semi")
        .withColumn("place", F.monotonically_increasing_id())
        .repartitionByRange(max(2, -(-total // block_steps)), key, *order)
        .withColumn("range", F.spark_partition_id()), "long-messages")
    sums = ranges.groupBy(key, "range").agg(*(F.sum(m).alias(m) for m in METRICS))
    earlier = W.partitionBy(key).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(
        F.col(key).alias("long_key"), F.col("range").alias("long_range"),
        *(F.sum(m).over(earlier).alias(f"{m}_before") for m in METRICS))

    def added(metric: str) -> Column:
        before, here = F.col(f"{metric}_before"), F.col(metric)
        known = F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
        return F.when(before.isNotNull() | here.isNotNull(), known)

    long = _running(ranges, [key, "range"], order).join(
        carried, is_long & (F.col("range") == F.col("long_range"))).withColumns(
        {m: added(m) for m in METRICS})
    return _running(short, [key], [step, *tie_break]).unionByName(long.select(*calls.columns))


def _running(calls: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    window = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return calls.withColumns({m: F.sum(m).over(window) for m in METRICS})


def run_totals(records: DataFrame, *, dead_letters: int = 0, dropped: int = 0) -> DataFrame:
    """One row: processed, durable and lost failures, token sums (NULL if never seen)."""
    return records.agg(
        F.count(F.lit(1)).alias("messages_processed"),
        F.lit(dead_letters).cast("bigint").alias("messages_dlq"),
        F.lit(dropped).cast("bigint").alias("messages_dlq_dropped"),
        *(F.sum(m).alias(f"{m}_sum") for m in METRICS),
    )


def known_totals(spark: SparkSession, processed: int, dead_letters: int, dropped: int,
                 tokens_prompt: int | None, tokens_completion: int | None) -> DataFrame:
    """:func:`run_totals` from counts that were observed on the way."""
    return spark.createDataFrame(
        [(processed, dead_letters, dropped, tokens_prompt, tokens_completion)],
        "messages_processed bigint, messages_dlq bigint, messages_dlq_dropped bigint, "
        + ", ".join(f"{m}_sum bigint" for m in METRICS))


def outcome_counts(df: DataFrame) -> DataFrame:
    """One row over carried errors: successes, and failures by stage."""
    from msgpipe.schemas import STAGES

    return df.agg(
        F.count_if(F.col("err").isNull()).alias("processed"),
        F.count_if(F.col("err").isNotNull()).alias("failed"),
        *(F.count_if(F.coalesce(F.col("err.stage") == s, F.lit(False))).alias(f"failed_{s}")
          for s in STAGES),
    )


def totals_line(totals: DataFrame) -> DataFrame:
    """The telemetry line: numbers only, ``None`` for sums never observed."""
    def shown(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    names = ("messages_processed", "messages_dlq", "messages_dlq_dropped",
             "tokens_prompt_sum", "tokens_completion_sum")
    pairs = [F.concat(F.lit(f"{n}="), shown(n)) for n in names]
    return totals.select(F.concat_ws(" ", F.lit("run_totals"), *pairs).alias("value"))


def completion_lines(timed: DataFrame) -> DataFrame:
    """One ``summary_completed`` line per record with a duration: id and numbers only."""
    def shown(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    return timed.select(F.concat(
        F.lit("summary_completed message_id="), F.col("source_message_id"),
        F.lit(" tokens_prompt="), shown("tokens_prompt"),
        F.lit(" tokens_completion="), shown("tokens_completion"),
        F.lit(" duration_ms="), F.col("duration_ms").cast("string"),
    ).alias("value"))
