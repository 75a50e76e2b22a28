"""Raw message resources as rows of (message_id, payload)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpipe.functions import variants as V
from msgpipe.functions.checks import refuse
from msgpipe.operators.firsts import first_per_key
from msgpipe.schemas import RAW_MESSAGE, carried_error, error_struct, first_error

# Files of a message folder that are not messages.
RESPONSES_FILE = "llm_responses.json"
POISON_PREFIX = "poison_"


def resource_error(payload: Column) -> Column:
    """Why a resource cannot be a message at all, NULL if it can."""
    return (
        F.when(payload.isNull(), F.lit("invalid JSON"))
        .when(~V.is_object(payload), F.lit("resource is not a JSON object"))
        .when(~V.truthy(V.member(payload, "id")), F.lit("missing top-level 'id'"))
        .when(~V.is_string(V.member(payload, "id")), F.lit("'id' is not text"))
    )


def _from_text(lines: DataFrame, strict: bool) -> DataFrame:
    """(value, origin, position) rows to raw messages."""
    parsed = lines.withColumn("payload", V.parse_whole(F.col("value")))
    problem = resource_error(F.col("payload"))
    located = F.concat(F.col("origin"), F.lit(": "), problem)
    message_id = V.text(F.col("payload"), "id")
    if strict:
        parsed = refuse(parsed, located)
        err = F.lit(None).cast("string")
    else:
        message_id = F.when(problem.isNull(), message_id)
        err = located
    return parsed.select(
        message_id.alias("message_id"), "payload", "origin", "position",
        error_struct("read", err).alias("err"),
    )


def read_message_files(spark: SparkSession, folder: str, *, strict: bool = True) -> DataFrame:
    """One message per ``*.json`` file of a folder; the file name gives the order.

    The responses file and poison files are left out. ``strict`` makes the job
    fail naming the path of a bad file; otherwise bad files are rows with a
    ``read`` error.
    """
    name = F.col("_metadata.file_name")
    files = (
        spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
        .filter((name != RESPONSES_FILE) & ~name.startswith(POISON_PREFIX))
        .select("value", F.col("_metadata.file_path").alias("origin"),
                F.lit(0).cast("bigint").alias("position"))
    )
    return _from_text(files, strict)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as (value, origin, position); position follows line order.

    Large files are read in splits. A split's offset in its file and the row
    order within the split give every line its place without a sort.
    """
    lines = spark.read.text(path)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return lines.select(
        "value", F.col("_metadata.file_path").alias("origin"),
        (F.col("_metadata.file_block_start") + row).alias("position"),
    )


def read_message_lines(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """One message per line: the layout for large collections."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    return _from_text(lines, strict)


def from_table(df: DataFrame) -> DataFrame:
    """Any table with ``message_id`` and ``payload`` (VARIANT or JSON text) as raw messages."""
    payload = F.col("payload")
    if dict(df.dtypes)["payload"] == "string":
        payload = V.parse_whole(payload)
        problem = F.when(payload.isNull(), F.lit("invalid JSON"))
    else:
        problem = F.when(payload.isNull(), F.lit("payload is missing"))
    return df.select("message_id", payload.alias("payload"),
                     error_struct("read", problem).alias("err"))


def read_message_table(spark: SparkSession, path: str) -> DataFrame:
    return from_table(spark.read.parquet(path))


def get_messages(raw: DataFrame, ids: DataFrame, *, order: Sequence[str] = ()) -> DataFrame:
    """Resolve requested ids to payloads: one row per request, whatever ``raw`` repeats.

    ``ids`` has a ``message_id`` column. An empty or unknown id is a ``read`` error of
    that row; an error that ``raw`` carries stays. Of several versions of a message the
    first by the columns ``order`` counts, which are carried along; without them the choice
    is fixed but arbitrary, a readable version before any other.

    The semi join cuts the raw table down first, so a short list is broadcast (Spark
    checks its size) and the large table is not shuffled. Empty ids, possibly many, take
    no part in the joins.
    """
    requested = ids.select(F.coalesce("message_id", F.lit("")).alias("message_id"))
    named = requested.filter("message_id <> ''")
    hits = raw.select("message_id", "payload", carried_error(raw).alias("err"), *order).join(
        named, "message_id", "left_semi")
    ranks = list(order) or [F.col("err").isNotNull(), F.to_json("payload"), F.to_json("err")]
    found = first_per_key(hits, "message_id", ranks).withColumn("found", F.lit(True))
    unknown = F.when(F.col("found").isNull(), F.concat(
        F.lit("unknown message_id: '"), F.col("message_id"), F.lit("'")))
    resolved = named.join(found, "message_id", "left").select(
        "message_id", "payload",
        first_error(F.col("err"), error_struct("read", unknown)).alias("err"), *order)
    unnamed = requested.filter("message_id = ''").select(
        "message_id", F.lit(None).cast("variant").alias("payload"),
        error_struct("read", F.lit("no message_id given")).alias("err"),
        *(F.lit(None).cast(raw.schema[c].dataType).alias(c) for c in order))
    return resolved.unionByName(unnamed)


def empty_raw(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RAW_MESSAGE)
