"""Stored tables: records appended once, dead letters always, batches whole or not at all.

A batch writes below folders of its own and counts from the moment its row is in the
ledger; what a batch that never got there left behind is not read. A batch may carry a
token: one that is in the ledger adds nothing when it is run again.

Parquet has no transactions across writers: one writer at a time may append to a store.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgpipe.operators.firsts import first_per_key
from msgpipe.operators.guarded import write_guarded
from msgpipe.operators.key_index import BUCKET_KEYS, BUCKETS, KeyIndex
from msgpipe.operators.records import flatten_records
from msgpipe.schemas import (
    DEAD_LETTER,
    STORED_RECORD,
    clock,
    constraint_error,
    require_valid,
)
from msgpipe.session import remove

KEY = "source_message_id"
# Folder of a table that belongs to no batch: it gives an empty table its files.
_NO_BATCH = "none"
_LEDGER = ("token string, attempt string, inserted bigint, ignored bigint, refused bigint, "
           "dead_letters bigint, dropped bigint, committed_at timestamp")


@dataclass(frozen=True)
class Appended:
    """What became of the records of one call.

    ``refused`` rows broke a constraint or made the write fail; ``letters`` files them as
    dead letters of the stage ``persist`` (None if there are none).
    """

    inserted: int
    ignored: int
    refused: int = 0
    letters: DataFrame | None = None


@dataclass(frozen=True)
class Commit:
    """A row of the ledger."""

    token: str
    attempt: str
    inserted: int
    ignored: int
    refused: int
    dead_letters: int
    dropped: int


@dataclass(frozen=True)
class Store:
    """The two tables of a store below one folder, its key index and its ledger."""

    spark: SparkSession
    path: str
    # An open batch: its name for callers, and the name its files carry.
    token: str | None = None
    attempt: str | None = None

    @property
    def records_path(self) -> str:
        return f"{self.path}/summary_records"

    @property
    def dead_letters_path(self) -> str:
        return f"{self.path}/dead_letters"

    @property
    def ledger_path(self) -> str:
        return f"{self.path}/commits"

    @property
    def index(self) -> KeyIndex:
        return KeyIndex(self.spark, f"{self.path}/key_index")

    def create(self, buckets: int = BUCKETS, bucket_keys: int = BUCKET_KEYS) -> Store:
        """Create tables, ledger and index if they are absent; repeatable.

        ``buckets`` and ``bucket_keys`` size a new key index.
        """
        for path, schema in ((self.records_path, STORED_RECORD),
                             (self.dead_letters_path, DEAD_LETTER)):
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(
                f"{path}/attempt={_NO_BATCH}/piece={_NO_BATCH}")
        self.spark.createDataFrame([], _LEDGER).write.mode("ignore").json(
            f"{self.ledger_path}/batch={_NO_BATCH}")
        self.index.create(buckets, bucket_keys)
        return self

    # Reading: only what batches in the ledger wrote.

    def commits(self) -> DataFrame:
        return self.spark.read.schema(_LEDGER).json(self.ledger_path).drop("batch")

    def _committed(self, path: str, schema) -> DataFrame:
        rows = self.spark.read.schema(f"{schema.toDDL()}, attempt string").parquet(path)
        return rows.join(self.commits().select("attempt"), "attempt", "left_semi").select(
            *schema.names)

    def records(self) -> DataFrame:
        return self._committed(self.records_path, STORED_RECORD)

    def dead_letters(self) -> DataFrame:
        return self._committed(self.dead_letters_path, DEAD_LETTER)

    # Batches.

    def _ledger_row(self, token: str) -> str:
        return f"{self.ledger_path}/batch={hashlib.sha256(token.encode()).hexdigest()[:32]}"

    def committed(self, token: str) -> Commit | None:
        """The batch of that token if it has ended; looks at one file, however many there are."""
        try:
            row = self.spark.read.schema(_LEDGER).json(self._ledger_row(token)).first()
        except AnalysisException:
            return None
        return row and Commit(*(row[f] for f in Commit.__dataclass_fields__))

    def begin(self, token: str | None = None) -> Store:
        """An open batch: appends to it are seen by nobody until :meth:`commit`.

        A token that has been committed cannot be begun again; ask :meth:`committed` first.
        """
        if token is not None and self.committed(token):
            raise ValueError(f"batch {token!r} is committed already")
        attempt = uuid.uuid4().hex
        return replace(self, token=token or attempt, attempt=attempt)

    @property
    def folder_name(self) -> str:
        """A name for folders of an open batch's other output, the same when it is retried."""
        return f"batch={hashlib.sha256(self.token.encode()).hexdigest()[:16]}"

    def commit(self, appended: Appended | None = None, dead_letters: int = 0,
               dropped: int = 0) -> Commit:
        """End an open batch: its keys go to the index, then its row makes it count."""
        inserted, ignored, refused = (
            (appended.inserted, appended.ignored, appended.refused) if appended else (0, 0, 0))
        if inserted:
            held = self.commits().agg(F.sum("inserted")).first()[0] or 0
            own = self.spark.read.schema(f"{KEY} string").parquet(
                f"{self.records_path}/attempt={self.attempt}")
            self.index.add(own.select(F.col(KEY).alias("key")), self.attempt, held + inserted)
        row = Commit(self.token, self.attempt, inserted, ignored, refused, dead_letters, dropped)
        frame = self.spark.createDataFrame(
            [tuple(getattr(row, f) for f in Commit.__dataclass_fields__)],
            _LEDGER.rpartition(",")[0])
        (frame.withColumn("committed_at", F.current_timestamp()).coalesce(1)
         .write.mode("overwrite").json(self._ledger_row(self.token)))
        return row

    def vacuum(self) -> int:
        """Delete what batches left that never ended; returns the number of folders.

        Only for times when no batch is open.
        """
        ended = {r.attempt for r in self.commits().select("attempt").toLocalIterator()}
        gone = 0
        for path in (self.records_path, self.dead_letters_path):
            hadoop = self.spark._jvm.org.apache.hadoop.fs
            found = hadoop.Path(path, "attempt=*")
            files = found.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for entry in files.globStatus(found) or ():
                attempt = entry.getPath().getName().removeprefix("attempt=")
                if attempt != _NO_BATCH and attempt not in ended:
                    gone += remove(self.spark, entry.getPath().toString())
        return gone

    # Appending.

    def append_records(self, records: DataFrame, order: Sequence[str | Column],
                       now: Column | None = None,
                       made: Callable[[DataFrame], DataFrame] | None = None) -> Appended:
        """Append the records, nested or in stored form, whose id is not stored yet.

        The first per id wins. ``order`` ranks rows of one id; it may name extra columns of
        ``records`` and must be total for a repeatable choice. A row that breaks a constraint or
        makes the write fail is refused and does not keep the others out: it is filed as a
        ``persist`` dead letter, in an open batch left to the caller to file.

        The key index is asked before any stored key is read; records are written once, and
        counted while they are written.

        Columns that may fail for a row are best added by ``made``, row by row, to ``records``
        that hold all else, their ids among it: then the failing rows are found in one pass, see
        :func:`write_guarded`, and rows that are no first of their id are not made at all.
        """
        if self.attempt is None:
            batch = self.begin()
            appended = batch.append_records(records, order, now, made)
            filed = batch.append_dead_letters(appended.letters) if appended.refused else 0
            batch.commit(appended, filed)
            return appended
        nested = isinstance(records.schema["summary"].dataType, T.StructType)
        kind = "summary_record" if nested else "stored_record"
        total, unnamed = records.select(KEY).agg(
            F.count(F.lit(1)), F.count_if(F.coalesce(KEY, F.lit("")) == "")).first()
        named = records.where(F.col(KEY) != "") if unnamed else records
        known = self.index.stored(named.select(F.col(KEY).alias("key")),
                                  self.commits().select("attempt"))
        fresh = first_per_key(named, KEY, order).join(
            known.withColumnRenamed("key", KEY), KEY, "left_anti")
        if unnamed:
            # Rows without an id are not versions of one message: each is refused.
            fresh = fresh.unionByName(records.where(F.coalesce(KEY, F.lit("")) == ""))

        def judged(rows: DataFrame) -> DataFrame:
            return (made(rows) if made else rows).withColumn("refusal", constraint_error(kind))

        def kept(rows: DataFrame) -> DataFrame:
            valid = rows.where("refusal is null").drop("refusal")
            return flatten_records(valid) if nested else valid.select(*STORED_RECORD.names)

        def write(rows: DataFrame, piece: str) -> None:
            rows.write.mode("append").parquet(
                f"{self.records_path}/attempt={self.attempt}/piece={piece}")

        counters = {"first": F.count(F.lit(1)), "refused": F.count("refusal")}
        written = write_guarded(fresh, KEY, write, counters, kept, judged) if made else (
            write_guarded(judged(fresh), KEY, write, counters, kept))
        counts = {"first": 0, "refused": 0} | written.counts
        inserted = counts["first"] - counts["refused"]
        refused = counts["refused"] + len(written.failed)
        letters = self._refusals(written.rows or fresh, judged, written, clock() if now is None else now)
        return Appended(inserted, total - inserted - refused, refused, letters)

    def _refusals(self, fresh: DataFrame, judged: Callable[[DataFrame], DataFrame], written,
                  now: Column) -> DataFrame | None:
        """Dead letters for the rows that were left out."""
        parts = []
        names = ("source_message_id", "stage", "error", "traceback", "failed_at")
        if written.counts.get("refused"):
            # A filter by value reaches the scan, so failing rows are not computed again.
            failing = [key for key, _ in written.failed]
            sound = fresh.where(F.col(KEY).isNull() | ~F.col(KEY).isin(failing)) \
                if failing else fresh
            parts.append(judged(sound).where("refusal is not null").select(
                F.col(KEY), F.lit("persist"), "refusal", F.lit(""), now))
        if written.failed:
            parts.append(self.spark.createDataFrame(
                written.failed, f"{KEY} string, error string").select(
                KEY, F.lit("persist"), "error", F.lit(""), now))
        if not parts:
            return None
        return parts[0].toDF(*names) if len(parts) == 1 else parts[0].union(parts[1]).toDF(*names)

    def append_dead_letters(self, letters: DataFrame) -> int:
        """Append every dead letter, repeated ones too; returns the durable number.

        Letters are counted while they are written.
        """
        if self.attempt is None:
            batch = self.begin()
            filed = batch.append_dead_letters(letters)
            batch.commit(dead_letters=filed)
            return filed
        seen = Observation()
        (require_valid(letters, "dead_letter").observe(seen, F.count(F.lit(1)).alias("n"))
         .write.mode("append").parquet(
             f"{self.dead_letters_path}/attempt={self.attempt}/piece=0"))
        return seen.get["n"]
