"""Which messages to process: label names, label membership, newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgpipe.functions.dates import epoch_millis, millis_to_timestamp

# How many names or ids an error message quotes; the error itself carries them all.
PREVIEW = 100


class LabelNotFoundError(ValueError):
    """A label name has no id; ``available`` holds all names there are (name)."""

    def __init__(self, message: str, available: DataFrame):
        super().__init__(message)
        self.available = available


def preview(df: DataFrame, column: str) -> tuple[str, int]:
    """The first distinct values in order, for an error message, and the number of all.

    The values go with the error in full as a DataFrame; this is what it quotes.
    """
    values = df.select(column).distinct()
    rows = values.orderBy(column).limit(PREVIEW).collect()
    count = len(rows) if len(rows) < PREVIEW else values.count()
    text = ", ".join(str(r[0]) for r in rows)
    return text + (f", ... ({count} in all)" if count > len(rows) else ""), count


def resolve_label(labels: DataFrame, name: str) -> str:
    """Id of a label name. On repeated names the last row (by ``seq``, if given) wins."""
    order = F.col("seq") if "seq" in labels.columns else F.col("label_id")
    found = labels.filter(F.col("name") == name).agg(F.max_by("label_id", order)).first()[0]
    if found is None:
        names = preview(labels, "name")[0] or "(none)"
        raise LabelNotFoundError(f"label {name!r} not found. Available labels: {names}.",
                                 labels.select("name").distinct())
    return found


def message_index(raw: DataFrame, *more: Column) -> DataFrame:
    """Id, labels and time of raw messages, the columns a listing needs, and any ``more``."""
    millis = epoch_millis(F.try_variant_get("payload", "$.internalDate", "string"))
    return raw.select(
        "message_id",
        F.coalesce(F.try_variant_get("payload", "$.labelIds", "array<string>"),
                   F.array().cast("array<string>")).alias("labels"),
        millis_to_timestamp(millis).alias("received_at"), *more,
    )


def list_messages(index: DataFrame, label_id: str, max_results: int | None = None) -> DataFrame:
    """Ids under a label, newest first when capped.

    ``None`` lists all (no sort), zero or less lists nothing. A cap becomes a
    per-partition top-n, never a full sort.
    """
    hits = index.filter(F.array_contains("labels", label_id))
    if max_results is None:
        return hits.select("message_id")
    if max_results <= 0:
        return hits.select("message_id").limit(0)
    return (hits.orderBy(F.col("received_at").desc_nulls_last(), "message_id")
            .limit(max_results).select("message_id"))


def list_by_label(raw: DataFrame, labels: DataFrame, name: str,
                  limit: int | None = 5) -> DataFrame:
    """List by label *name*; a cap below one is refused before anything runs."""
    if limit is not None and limit < 1:
        raise ValueError(f"limit must be at least 1, got {limit}")
    return list_messages(message_index(raw), resolve_label(labels, name), limit)


def label_index(index: DataFrame) -> DataFrame:
    """One row per (label, message) for label-partitioned storage.

    Parquet cannot skip on array members; partitioned by ``label_id`` a listing
    reads its own label only.
    """
    return index.select(F.explode("labels").alias("label_id"), "message_id", "received_at")


def list_indexed(index: DataFrame, label_id: str, max_results: int | None = None) -> DataFrame:
    """:func:`list_messages` on a stored label index: only the label's partition is read."""
    hits = index.filter(F.col("label_id") == label_id)
    if max_results is None:
        return hits.select("message_id")
    return (hits.orderBy(F.col("received_at").desc_nulls_last(), "message_id")
            .limit(max(max_results, 0)).select("message_id"))


def write_label_index(index: DataFrame, path: str) -> None:
    """Store :func:`label_index`; the rebalance keeps files few and splits hot labels."""
    (label_index(index).hint("rebalance", "label_id")
     .write.mode("overwrite").partitionBy("label_id").parquet(path))
