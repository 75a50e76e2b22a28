"""A feed of messages into a store; overlapping feeds never double a record."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from msgpipe.operators.store import Store
from msgpipe.plans.batch import ingest


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The stream's own id: it lives as long as its checkpoint, over restarts."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _start(feed: DataFrame, store: Store, handle: Callable[[DataFrame, int, str], None],
           checkpoint: str, available_now: bool) -> StreamingQuery:
    """Run ``handle(batch, number, token)`` on each micro-batch that is not in the ledger yet."""
    store.create()

    def once(batch: DataFrame, number: int) -> None:
        token = f"{_query_id(store.spark, checkpoint)}/{number}"
        if store.committed(token) is None:
            handle(batch, number, token)

    writer = feed.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_messages(feed: DataFrame, store: Store, model: str, checkpoint: str, *,
                    order: Sequence[str] = (), available_now: bool = False,
                    **options) -> StreamingQuery:
    """Run the batch job on every micro-batch of a raw-message stream.

    The first version of a message wins, within a batch by ``order`` and across
    batches because the store is asked. The store is the only state, so nothing
    grows with the stream's age but the store itself. A micro-batch is stored exactly once,
    records and dead letters alike: it is in the ledger under the stream's id and its number
    when all of it is stored, and a retry of one that is does nothing. With an ``emit_path``,
    each micro-batch has its own folder below it, which a retry replaces.
    """
    def handle(batch: DataFrame, number: int, token: str) -> None:
        own = dict(options)
        if own.get("emit_path") is not None:
            own["emit_path"] = f"{own['emit_path'].rstrip('/')}/batch-{number:08d}"
        ingest(batch, store, model, order=order, token=token, **own)

    return _start(feed, store, handle, checkpoint, available_now)


def stream_records(feed: DataFrame, store: Store, checkpoint: str, *,
                   order: Sequence[str | Column], available_now: bool = False,
                   ) -> StreamingQuery:
    """Append a stream of finished records (nested or stored form) once per id.

    Each micro-batch is stored exactly once, as by :func:`stream_messages`; records the
    store refuses are filed as dead letters.
    """
    def handle(batch: DataFrame, number: int, token: str) -> None:
        own = store.begin(token)
        appended = own.append_records(batch, order)
        filed = own.append_dead_letters(appended.letters) if appended.refused else 0
        own.commit(appended, filed)

    return _start(feed, store, handle, checkpoint, available_now)
