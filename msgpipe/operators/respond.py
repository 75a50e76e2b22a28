"""One structured answer per message: joined from a table or computed by a callable."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgpipe.functions import variants as V
from msgpipe.functions.answers import answer_error, summary_struct
from msgpipe.functions.content import content_text
from msgpipe.operators.firsts import first_per_key
from msgpipe.schemas import carried_error, error_struct, first_error
from msgpipe.session import stage
from msgpipe.sources.listing import preview


class MissingResponseError(LookupError):
    """Messages without a prepared answer; ``missing`` holds all their ids (message_id)."""

    def __init__(self, message: str, missing: DataFrame):
        super().__init__(message)
        self.missing = missing


@dataclass
class Reply:
    """What a responder gives back for one prompt.

    ``content`` is text or a list of content blocks; ``usage`` has one
    (prompt, completion) pair per call made, None where a call did not report it.
    """

    content: Any
    usage: Sequence[tuple[int | None, int | None]] = field(default_factory=list)
    stop_reason: str = "unknown"


class Responder(Protocol):
    def __call__(self, prompt: str, system: str | None) -> Reply: ...


def lookup_responses(messages: DataFrame, responses: DataFrame) -> DataFrame:
    """Join answers by message id; a message without one gets a ``summarize`` error.

    Of several answers to one id the last counts, by the responses' ``seq`` if they have
    one, so each message stays one row. Which ids repeat is found from the keys alone:
    answer texts are shuffled only for those, the others go to the join as they are.
    The join side is Spark's choice by measured size: small response tables are
    broadcast, large ones are merged, and AQE splits skewed message ids.
    """
    given = responses.where(F.col("message_id").isNotNull())
    repeated = given.groupBy("message_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "message_id")
    last = F.max_by("answer", "seq") if "seq" in responses.columns else F.max("answer")
    several = given.join(repeated, "message_id", "left_semi").groupBy("message_id").agg(
        last.alias("answer"))
    answers = (
        given.join(repeated, "message_id", "left_anti").select("message_id", "answer")
        .unionByName(several).withColumn("answered", F.lit(True)))
    joined = messages.join(answers, "message_id", "left")
    missing = F.when(F.col("answered").isNull(), F.concat(
        F.lit("no answer for message_id '"), F.coalesce("message_id", F.lit("")), F.lit("'")))
    return joined.withColumns({
        "err": first_error(carried_error(joined), error_struct("summarize", missing)),
    }).drop("answered")


def missing_responses(messages: DataFrame, responses: DataFrame) -> DataFrame:
    """Ids without an answer, each once."""
    return (messages.select("message_id").join(responses, "message_id", "left_anti")
            .distinct())


def require_responses(messages: DataFrame, responses: DataFrame) -> None:
    """Raise before any output if an answer is missing.

    The message says how many are missing and quotes the first ids; the error's
    ``missing`` has them all, so the driver need not hold them.
    """
    missing = missing_responses(messages, responses)
    ids, count = preview(missing, "message_id")
    if count:
        raise MissingResponseError(f"no answers for {count} message_ids: {ids}", missing)


REPLY_FIELDS = T.StructType([
    T.StructField("reply", T.StringType()),
    T.StructField("stop_reason", T.StringType()),
    T.StructField("tokens_prompt", T.LongType()),
    T.StructField("tokens_completion", T.LongType()),
    T.StructField("failure", T.StringType()),
    T.StructField("traceback", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
])


def _answer_batches(make_responder: Callable[[], Responder], system: str | None,
                    in_flight: int):
    """mapInPandas function: one responder per task, one guarded call per row."""

    def error_text(error):
        for show in (str, repr):
            try:
                text = show(error)
            except Exception:
                continue
            if text:
                return text
        return f"<{type(error).__name__}>"

    def total(counts):
        known = [c for c in counts if c is not None]
        return sum(known) if known else None

    def answer(respond, prompt):
        import time

        started = time.monotonic_ns()
        return (*guarded(respond, prompt), (time.monotonic_ns() - started) // 1_000_000)

    def guarded(respond, prompt):
        import json
        import traceback

        try:
            reply = respond(prompt, system)
            usage = list(reply.usage)
            return (json.dumps(reply.content), reply.stop_reason,
                    total(p for p, _ in usage), total(c for _, c in usage), None, None)
        except Exception as error:
            return None, None, None, None, error_text(error), traceback.format_exc()

    def batches(frames):
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd

        respond = make_responder()
        names = ["reply", "stop_reason", "tokens_prompt", "tokens_completion",
                 "failure", "traceback", "duration_ms"]
        skipped = (None,) * len(names)

        def one(row):
            prompt, failed = row
            return skipped if failed else answer(respond, prompt)

        with ThreadPoolExecutor(in_flight) as pool:
            ask = pool.map if in_flight > 1 else map
            # The next frame is not fetched before this one is answered and handed on.
            for frame in frames:
                rows = list(ask(one, zip(frame["prompt"], frame["failed"])))
                replies = pd.DataFrame(rows, columns=names, index=frame.index, dtype=object)
                yield pd.concat([frame.drop(columns=["prompt", "failed"]), replies], axis=1)

    return batches


def _ask(messages: DataFrame, make_responder: Callable[[], Responder], system: str | None,
         keep: Sequence[str], parallelism: int | None, in_flight: int) -> DataFrame:
    """The ``keep`` columns, ``err`` and the raw reply of every message."""
    if in_flight < 1:
        raise ValueError(f"in_flight must be at least 1, got {in_flight}")
    narrow = messages.select(
        *keep, carried_error(messages).alias("err"), "prompt",
        carried_error(messages).isNotNull().alias("failed"))
    if parallelism is not None:
        narrow = narrow.repartition(parallelism)
    schema = T.StructType([
        *(f for f in narrow.schema if f.name not in ("prompt", "failed")), *REPLY_FIELDS])
    return narrow.mapInPandas(_answer_batches(make_responder, system, in_flight), schema)


def _answered(replies: DataFrame) -> DataFrame:
    failure = error_struct("summarize", F.col("failure"), F.col("traceback"))
    return answer_text(replies.withColumn("err", first_error(F.col("err"), failure))).drop(
        "failure", "traceback")


def respond_with(messages: DataFrame, make_responder: Callable[[], Responder], *,
                 system: str | None = None, keep: Sequence[str] = ("message_id", "subject"),
                 parallelism: int | None = None, in_flight: int = 1) -> DataFrame:
    """Ask a responder once per message that has no error yet.

    ``make_responder`` runs once per task, so it can open its client there;
    ``parallelism`` spreads the calls over that many tasks, and each task has up to
    ``in_flight`` calls under way, from as many threads; the rows keep their order. A task
    holds one batch of rows at a time (spark.sql.execution.arrow.maxRecordsPerBatch).
    Needs ``prompt``; only the ``keep`` columns travel to Python and back. Every
    failed call becomes that row's ``summarize`` error with its traceback, and
    ``duration_ms`` holds how long the call took. Stage the result before using it twice.
    """
    return _answered(_ask(messages, make_responder, system, keep, parallelism, in_flight))


def respond_kept(messages: DataFrame, make_responder: Callable[[], Responder], path: str, *,
                 system: str | None = None, keep: Sequence[str] = ("message_id", "subject"),
                 parallelism: int | None = None, in_flight: int = 1,
                 waves: int = 8) -> DataFrame:
    """:func:`respond_with`, with every reply kept below ``path`` for the next run.

    A reply belongs to its prompt and system text. Messages are asked in ``waves``, each
    written when it ends, so a run that breaks off loses one wave at most and the next one
    asks only what is missing. Calls that failed are asked again by the next run. Messages with the
    same prompt share one call.
    """
    if waves < 1:
        raise ValueError(f"waves must be at least 1, got {waves}")
    spark = messages.sparkSession
    run = uuid.uuid4().hex
    asked = F.sha2(F.concat_ws("\0", F.lit(system), "prompt"), 256)
    schema = T.StructType([T.StructField("asked", T.StringType()),
                           T.StructField("run", T.StringType()), *REPLY_FIELDS])
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    # Every wave reads the prompts; they are rendered once.
    messages = stage(messages.select(*keep, carried_error(messages).alias("err"), "prompt"),
                     "prompts")
    open_ = messages.where(carried_error(messages).isNull()).select(
        asked.alias("asked"), "prompt")
    for wave in range(waves):
        own = open_.where(F.pmod(F.xxhash64("asked"), F.lit(waves)) == wave)
        kept = spark.read.schema(schema).parquet(path).where("failure is null").select("asked")
        missing = own.join(kept, "asked", "left_anti").groupBy("asked").agg(
            F.any_value("prompt").alias("prompt"))
        (_ask(missing, make_responder, system, ("asked",), parallelism, in_flight)
         .select("asked", F.lit(run).alias("run"), *REPLY_FIELDS.names)
         .write.mode("append").parquet(path))
    # A reply beats a failure; of failures only this run's count.
    replies = spark.read.schema(schema).parquet(path).where(
        (F.col("failure").isNull()) | (F.col("run") == run))
    first = first_per_key(replies, "asked", [F.col("failure").isNotNull(), "run"]).drop("run")
    return _answered(
        messages.select(*keep, carried_error(messages).alias("err"), F.when(
            carried_error(messages).isNull(), asked).alias("asked"))
        .join(first, "asked", "left").drop("asked"))


def answer_text(replies: DataFrame) -> DataFrame:
    """Replies (JSON of content) to answer text; a reply without text is an error.

    The error names the stop reason and the block types, never the content.
    """
    content = V.parse(F.col("reply"))
    text = content_text(content)
    types = F.transform(
        F.coalesce(F.try_variant_get(content, "$", "array<variant>"),
                   F.array().cast("array<variant>")),
        lambda b: F.concat(F.lit("'"), F.coalesce(
            F.try_variant_get(b, "$.type", "string"), F.lit("unknown")), F.lit("'")))
    empty = F.when(F.col("reply").isNotNull() & (text == ""), F.concat(
        F.lit("responder returned no text (stop_reason='"),
        F.coalesce("stop_reason", F.lit("unknown")),
        F.lit("', block_types=["), F.array_join(types, ", "), F.lit("])")))
    return replies.withColumns({
        "answer": F.when(F.col("reply").isNotNull(), text),
        "err": first_error(carried_error(replies), error_struct("summarize", empty)),
    }).drop("reply", "stop_reason")


def validate_answers(df: DataFrame) -> DataFrame:
    """``answer`` text to the ``summary`` struct, or a ``summarize`` error."""
    parsed = df.withColumn("answer_value", V.parse_whole(F.col("answer")))
    problem = answer_error(F.col("answer"), F.col("answer_value"))
    checked = parsed.withColumn(
        "err", first_error(carried_error(df), error_struct("summarize", problem)))
    summary = F.when(F.col("err").isNull(), summary_struct(F.col("answer_value")))
    return checked.withColumn("summary", summary).drop("answer", "answer_value")
