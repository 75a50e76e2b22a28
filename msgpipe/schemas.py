"""Record types, their defaults and their constraints."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgpipe.functions.checks import refuse

STRINGS = T.ArrayType(T.StringType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


RAW_MESSAGE = _struct(("message_id", T.StringType()), ("payload", T.VariantType()))

EMAIL_MESSAGE = _struct(
    ("message_id", T.StringType()),
    ("thread_id", T.StringType()),
    ("subject", T.StringType()),
    ("sender", T.StringType()),
    ("recipients", STRINGS),
    ("labels", STRINGS),
    ("received_at", T.TimestampType()),
    ("body_text", T.StringType()),
    ("snippet", T.StringType()),
    ("attachment_filenames", STRINGS),
)

SUMMARY = _struct(
    ("tl_dr", T.StringType()),
    ("summary", T.StringType()),
    ("key_points", STRINGS),
    ("action_items", STRINGS),
    ("category", T.StringType()),
)

SUMMARY_RECORD = _struct(
    ("source_message_id", T.StringType()),
    ("subject", T.StringType()),
    ("summary", SUMMARY),
    ("model", T.StringType()),
    ("tokens_prompt", T.LongType()),
    ("tokens_completion", T.LongType()),
    ("created_at", T.TimestampType()),
)

# The stored form of a record: the summary flattened into columns.
STORED_RECORD = _struct(
    ("source_message_id", T.StringType()),
    ("subject", T.StringType()),
    *((f.name, f.dataType) for f in SUMMARY),
    ("model", T.StringType()),
    ("tokens_prompt", T.LongType()),
    ("tokens_completion", T.LongType()),
    ("created_at", T.TimestampType()),
)

DEAD_LETTER = _struct(
    ("source_message_id", T.StringType()),
    ("stage", T.StringType()),
    ("error", T.StringType()),
    ("traceback", T.StringType()),
    ("failed_at", T.TimestampType()),
)

# Why a row left the success path: carried along as one nullable column.
ERROR = _struct(
    ("stage", T.StringType()), ("error", T.StringType()), ("traceback", T.StringType())
)

# The stages a message can fail in, in processing order.
STAGES = ("read", "parse", "summarize", "persist")

SCHEMAS = {
    "raw_message": RAW_MESSAGE,
    "email_message": EMAIL_MESSAGE,
    "summary": SUMMARY,
    "summary_record": SUMMARY_RECORD,
    "stored_record": STORED_RECORD,
    "dead_letter": DEAD_LETTER,
}


def _empty_list() -> Column:
    return F.array().cast(STRINGS)


# Columns that may be left out, and what stands in for them. A callable gets the
# run's clock; everything not listed here or nullable must be given.
DEFAULTS: dict[str, dict[str, Callable[[Column], Column]]] = {
    "raw_message": {"payload": lambda now: F.parse_json(F.lit("{}"))},
    "email_message": {
        "thread_id": lambda now: F.lit(None),
        "subject": lambda now: F.lit(""),
        "recipients": lambda now: _empty_list(),
        "labels": lambda now: _empty_list(),
        "body_text": lambda now: F.lit(""),
        "snippet": lambda now: F.lit(None),
        "attachment_filenames": lambda now: _empty_list(),
    },
    "summary": {
        "key_points": lambda now: _empty_list(),
        "action_items": lambda now: _empty_list(),
    },
    "summary_record": {
        "subject": lambda now: F.lit(""),
        "tokens_prompt": lambda now: F.lit(None),
        "tokens_completion": lambda now: F.lit(None),
        "created_at": lambda now: now,
    },
    "stored_record": {
        "subject": lambda now: F.lit(""),
        "key_points": lambda now: _empty_list(),
        "action_items": lambda now: _empty_list(),
        "tokens_prompt": lambda now: F.lit(None),
        "tokens_completion": lambda now: F.lit(None),
        "created_at": lambda now: now,
    },
    "dead_letter": {
        "source_message_id": lambda now: F.lit(None),
        "traceback": lambda now: F.lit(""),
        "failed_at": lambda now: now,
    },
}


def _empty(name: str) -> tuple[str, Callable[[], Column]]:
    return f"{name} must not be empty", lambda: F.coalesce(F.col(name), F.lit("")) == ""


def _missing(name: str) -> tuple[str, Callable[[], Column]]:
    return f"{name} must not be null", lambda: F.col(name).isNull()


def _negative(name: str) -> tuple[str, Callable[[], Column]]:
    return f"{name} must not be negative", lambda: F.col(name) < 0


def _null_item(name: str) -> tuple[str, Callable[[], Column]]:
    return (f"{name} must be a list of strings",
            lambda: F.col(name).isNull() | F.exists(F.col(name), lambda x: x.isNull()))


# (message, "is violated") per record, checked in this order.
CONSTRAINTS: dict[str, list[tuple[str, Callable[[], Column]]]] = {
    "raw_message": [_empty("message_id"), _missing("payload")],
    "email_message": [
        _empty("message_id"), _missing("subject"), _missing("sender"),
        _null_item("recipients"), _null_item("labels"), _missing("received_at"),
        _missing("body_text"), _null_item("attachment_filenames"),
    ],
    "summary": [
        _empty("tl_dr"), _empty("summary"), _null_item("key_points"),
        _null_item("action_items"), _empty("category"),
    ],
    "summary_record": [
        _empty("source_message_id"), _missing("subject"), _missing("summary"),
        _empty("summary.tl_dr"), _empty("summary.summary"),
        _null_item("summary.key_points"), _null_item("summary.action_items"),
        _empty("summary.category"), _empty("model"),
        _negative("tokens_prompt"), _negative("tokens_completion"), _missing("created_at"),
    ],
    "stored_record": [
        _empty("source_message_id"), _missing("subject"), _empty("tl_dr"), _empty("summary"),
        _null_item("key_points"), _null_item("action_items"), _empty("category"),
        _empty("model"), _negative("tokens_prompt"), _negative("tokens_completion"),
        _missing("created_at"),
    ],
    "dead_letter": [
        ("stage must be one of " + ", ".join(STAGES),
         lambda: ~F.coalesce(F.col("stage").isin(*STAGES), F.lit(False))),
        _empty("error"), _missing("traceback"), _missing("failed_at"),
    ],
}


def constraint_error(kind: str) -> Column:
    """Message of the first constraint a row violates, NULL if it keeps them all."""
    return F.coalesce(*(F.when(violated(), F.lit(message))
                        for message, violated in CONSTRAINTS[kind]))


def conform(df: DataFrame, kind: str, now: Column | None = None) -> DataFrame:
    """Exactly the columns of a record type: defaults filled in, nothing unknown.

    ``now`` is the run's clock for time defaults; a fixed literal keeps a
    re-planned job from changing it.
    """
    schema, defaults = SCHEMAS[kind], DEFAULTS[kind]
    unknown = sorted(set(df.columns) - set(schema.names))
    if unknown:
        raise ValueError(f"{kind}: unknown columns {unknown}")
    lacking = [n for n in schema.names if n not in df.columns and n not in defaults]
    if lacking:
        raise ValueError(f"{kind}: missing columns {lacking}")
    now = now if now is not None else F.current_timestamp()
    return df.select(*(
        (F.col(f.name) if f.name in df.columns else defaults[f.name](now))
        .cast(f.dataType).alias(f.name)
        for f in schema
    ))


def require_valid(df: DataFrame, kind: str, now: Column | None = None) -> DataFrame:
    """Conform ``df`` and make the job fail on the first row that breaks a constraint."""
    conformed = conform(df, kind, now)
    return refuse(conformed, F.concat(F.lit(f"{kind}: "), constraint_error(kind)))


def error_struct(stage: str, message: Column, traceback: Column | None = None) -> Column:
    """Error column: NULL where ``message`` is NULL."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}")
    traceback = traceback if traceback is not None else F.lit("")
    return F.when(message.isNotNull(), F.struct(
        F.lit(stage).alias("stage"), message.alias("error"),
        F.coalesce(traceback, F.lit("")).alias("traceback"),
    ))


def first_error(*errors: Column) -> Column:
    """Errors in processing order: the first one counts."""
    return reduce(lambda a, b: F.coalesce(a, b), errors)


def no_error() -> Column:
    return F.lit(None).cast(ERROR)


def carried_error(df: DataFrame) -> Column:
    return F.col("err") if "err" in df.columns else no_error()


def clock(now: datetime | None = None) -> Column:
    """One fixed time per run."""
    from datetime import UTC

    moment = (now or datetime.now(UTC))
    if moment.tzinfo is None:
        raise ValueError("the run's clock needs a time zone")
    return F.timestamp_micros(F.lit(
        round(moment.timestamp() * 1_000_000)).cast("bigint"))


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
