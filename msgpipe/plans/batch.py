"""The batch job: list, fetch, parse, redact, respond, validate, store, report."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from msgpipe.functions.prompt import render_prompt
from msgpipe.functions.redaction import DEFAULT_RULES, RedactionRule, redact_message
from msgpipe.operators.export import emit_records
from msgpipe.operators.firsts import first_per_key
from msgpipe.operators.parse import parse_messages
from msgpipe.operators.records import assemble_records, split
from msgpipe.operators.respond import (
    Responder,
    lookup_responses,
    respond_kept,
    respond_with,
    validate_answers,
)
from msgpipe.operators.store import Appended, Store
from msgpipe.operators.usage import (
    METRICS,
    completion_lines,
    known_totals,
    run_totals,
    totals_line,
)
from msgpipe.schemas import clock
from msgpipe.session import stage
from msgpipe.sources.archive import Archive
from msgpipe.sources.listing import list_messages, message_index, resolve_label
from msgpipe.sources.raw import get_messages

logger = logging.getLogger(__name__)


def prepare_messages(raw: DataFrame, rules: Sequence[RedactionRule] = DEFAULT_RULES, *,
                     keep: Sequence[str] = ()) -> DataFrame:
    """Raw messages to parsed, masked messages with their prompt."""
    parsed = redact_message(parse_messages(raw, keep=keep), rules)
    return parsed.withColumn(
        "prompt", render_prompt(F.col("subject"), F.col("sender"), F.col("body_text")))


def answer_messages(messages: DataFrame, *, responses: DataFrame | None = None,
                    make_responder: Callable[[], Responder] | None = None,
                    system: str | None = None, parallelism: int | None = None,
                    in_flight: int = 1, answers_path: str | None = None,
                    keep: Sequence[str] = ()) -> DataFrame:
    """Answers from a table or a callable; exactly one of the two.

    With ``answers_path`` the callable's replies are kept there, and only messages without one
    are asked.
    """
    if (responses is None) == (make_responder is None):
        raise ValueError("give either responses or make_responder")
    if responses is not None:
        return lookup_responses(messages.select("message_id", "subject", "err", *keep), responses)
    calls = {"system": system, "parallelism": parallelism, "in_flight": in_flight,
             "keep": ("message_id", "subject", *keep)}
    if answers_path is not None:
        return respond_kept(messages, make_responder, answers_path, **calls)
    return respond_with(messages, make_responder, **calls)


def summarize(raw: DataFrame, model: str, *, now: datetime | None = None,
              rules: Sequence[RedactionRule] = DEFAULT_RULES, keep: Sequence[str] = (),
              **answers) -> DataFrame:
    """Raw messages to records with ``err``: the whole row-wise part as one plan.

    ``keep`` names columns of ``raw`` to carry along; ``prompt`` among them is the one that was
    rendered. Other options are those of :func:`answer_messages`.
    """
    carried = [c for c in keep if c != "prompt"]
    answered = answer_messages(
        prepare_messages(raw, rules, keep=carried), keep=keep, **answers)
    return assemble_records(validate_answers(answered), model, clock(now), keep)


@dataclass(frozen=True)
class BatchResult:
    """Tables and counts of one run; a batch of failures only is still a result."""

    outcomes: DataFrame
    records: DataFrame
    dead_letters: DataFrame
    timings: DataFrame
    appended: Appended
    dead_letter_count: int
    dropped_count: int
    totals: DataFrame


def ingest(raw: DataFrame, store: Store, model: str, *, now: datetime | None = None,
           order: Sequence[str] = (), stage_mode: str = "true", emit_path: str | None = None,
           log_path: str | None = None, token: str | None = None,
           keep: Sequence[str] = (), **options) -> BatchResult:
    """Process raw messages into a store.

    ``order`` names the columns of ``raw`` that say which version of a repeated
    message came first; without it the choice among versions is fixed but arbitrary.
    ``keep`` names further columns that the outcomes carry, see :func:`summarize`.
    ``emit_path`` gets every record of the run as a JSON line, duplicates too. ``log_path``
    gets one completion line per record whose call was timed, in a folder for this batch;
    :func:`msgpipe.plans.capture.run_capture` reads them.

    The responder runs once: its outcome is staged, and counted as it is written; records,
    dead letters and lines are read from there. A duplicate is a success that adds no row.
    A record that the store refuses, or that makes the write fail, becomes a ``persist``
    dead letter. A dead-letter write that fails loses those rows from the store but not the
    records; they are counted as dropped. Nothing of the batch is visible in the store
    before all of it is; one with a ``token`` is stored once, see :class:`Store`.
    """
    moment = clock(now)
    store.create()
    batch = store.begin(token)
    seen = Observation()
    good = F.col("err").isNull()
    outcomes = stage(
        summarize(raw, model, now=now, keep=[*order, *keep], **options).observe(
            seen, F.count_if(good).alias("processed"), F.count_if(~good).alias("failed"),
            *(F.sum(F.when(good, F.col(m))).alias(m) for m in METRICS)), "outcomes")
    counts = seen.get
    records, letters = split(outcomes, moment, stage_mode=stage_mode, keep=order)
    appended = batch.append_records(
        records, order or ("subject", F.to_json("summary")), moment)
    timings = outcomes.filter("err is null and duration_ms is not null")
    if appended.refused:
        refused = stage(appended.letters, "refused")
        letters = letters.unionByName(refused)
        ids = refused.select("source_message_id")
        records = records.join(ids, "source_message_id", "left_anti")
        timings = timings.join(ids, "source_message_id", "left_anti")
    if emit_path is not None:
        emit_records(records, emit_path)
    if log_path is not None:
        completion_lines(timings).write.mode("overwrite").text(f"{log_path}/{batch.folder_name}")
    failures = counts["failed"] + appended.refused
    durable = 0
    if failures:
        try:
            durable = batch.append_dead_letters(letters)
        except Exception as error:
            logger.error("dead_letter_write_failed failures=%d exc_type=%s",
                         failures, type(error).__name__)
    batch.commit(appended, durable, failures - durable)
    if appended.refused:
        totals = run_totals(records, dead_letters=durable, dropped=failures - durable)
    else:
        totals = known_totals(store.spark, counts["processed"], durable, failures - durable,
                              *(counts[m] for m in METRICS))
    logger.info("%s", totals_line(totals).first()[0])
    timings = timings.select(F.col("source_message_id").alias("message_id"), "duration_ms")
    return BatchResult(outcomes, records, letters, timings, appended, durable,
                       failures - durable, totals)


def run_label_batch(raw: DataFrame | Archive, labels: DataFrame, label: str, store: Store,
                    model: str, *, limit: int | None = 5, order: Sequence[str] = (),
                    **options) -> BatchResult:
    """The newest ``limit`` messages under a label name, processed into a store.

    From an :class:`~msgpipe.sources.archive.Archive` only the label's part of its index and
    the files that hold the messages are read; ``order`` is for tables, an archive has its own.
    """
    if limit is not None and limit < 1:
        raise ValueError(f"limit must be at least 1, got {limit}")
    label_id = resolve_label(labels, label)
    if isinstance(raw, Archive):
        return ingest(raw.fetch(raw.newest(label_id, limit)), store, model,
                      order=("appended",), **options)
    index = message_index(raw, *(F.col(c) for c in order))
    if order:
        index = first_per_key(index, "message_id", order)
    ids = list_messages(index, label_id, limit)
    return ingest(get_messages(raw, ids, order=order), store, model, order=order, **options)
