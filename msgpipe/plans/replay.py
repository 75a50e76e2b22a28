"""Offline replay: messages and prepared answers of a folder to sample documents."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpipe.functions.checks import refuse
from msgpipe.operators.export import export_samples
from msgpipe.operators.respond import require_responses
from msgpipe.plans.batch import summarize
from msgpipe.schemas import SUMMARY_RECORD
from msgpipe.session import stage
from msgpipe.sources.raw import RESPONSES_FILE, read_message_files
from msgpipe.sources.responses import read_response_object

# Fixed value: the time every replayed record carries.
REPLAY_TIME = datetime(2026, 1, 1, tzinfo=UTC)


def replay(raw: DataFrame, responses: DataFrame, model: str,
           order: Sequence[str] = ("origin", "position"),
           keep: Sequence[str] = ()) -> DataFrame:
    """Records of a message set whose answers are all prepared; any failure fails the job.

    Answers missing for any message are reported before anything is computed. The
    ``order`` columns of ``raw`` are kept for numbering, those of ``keep`` as by
    :func:`~msgpipe.plans.batch.summarize`.
    """
    require_responses(raw, responses)
    outcomes = summarize(raw, model, now=REPLAY_TIME, responses=responses, keep=[*order, *keep])
    failed = F.concat_ws(": ", "source_message_id", "err.stage", "err.error")
    # Spark moves a filter below what it reads, and would parse an answer there again for each
    # mention of it. It does not move one past rows that are observed.
    seen = outcomes.observe("replayed", F.count_if(F.col("err").isNotNull()).alias("failed"))
    checked = refuse(seen, F.when(F.col("err").isNotNull(), failed))
    return checked.select(*SUMMARY_RECORD.names, *order, *keep)


def replay_folder(spark: SparkSession, folder: str, output: str, model: str) -> DataFrame:
    """Replay a folder of message files and replace the samples below ``output``.

    Everything that can fail does so while staging, before old samples go.
    """
    raw = read_message_files(spark, folder)
    if raw.isEmpty():
        raise ValueError(f"{folder}: no messages found")
    responses = read_response_object(spark, f"{folder.rstrip('/')}/{RESPONSES_FILE}")
    records = stage(replay(raw, responses, model), "replay")
    export_samples(records, output, ("origin", "position"))
    return records
