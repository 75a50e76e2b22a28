"""Writes that leave out the rows that fail, instead of failing whole."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgpipe.session import new_staging_path, stage

logger = logging.getLogger(__name__)

# Pieces that are tried at the same time.
AT_ONCE = 8
# Keys of suspect rows that share a file, and the column that says which.
PLACE_KEYS, PLACE = 32, "__place"
# Bits of a key's hash: pieces that agree in all of them are not taken apart further.
MAX_DEPTH = 60


@dataclass
class Written:
    """Counts observed while writing, summed over the pieces, and the keys left out.

    ``rows`` are those that ``made`` does not fail for, staged, if it fails for any.
    """

    counts: dict[str, int] = field(default_factory=dict)
    failed: list[tuple[str | None, str]] = field(default_factory=list)
    rows: DataFrame | None = None

    def add(self, counts: dict[str, int]) -> None:
        for name, value in counts.items():
            self.counts[name] = self.counts.get(name, 0) + (value or 0)


@dataclass(frozen=True)
class _Piece:
    """Rows whose key's hash ends in the given bits."""

    depth: int = 0
    rest: int = 0

    def of(self, rows: DataFrame, key: str) -> DataFrame:
        if not self.depth:
            return rows
        last = F.xxhash64(key).bitwiseAND(F.lit((1 << self.depth) - 1))
        return rows.where(last == self.rest)

    @property
    def name(self) -> str:
        return f"{self.depth}-{self.rest}"

    def halves(self) -> tuple[_Piece, _Piece]:
        return (_Piece(self.depth + 1, self.rest),
                _Piece(self.depth + 1, self.rest | 1 << self.depth))


def error_text(error: Exception) -> str:
    """What a failed job says, never empty; a row's own message without Spark's frame."""
    parameters = getattr(error, "getMessageParameters", lambda: None)() or {}
    text = parameters.get("errorMessage") or (str(error).strip() or repr(error)).splitlines()[0]
    return text.strip().strip("'") or type(error).__name__


def _failures(rows: DataFrame, key: str, made: Callable[[DataFrame], DataFrame],
              pool: ThreadPoolExecutor) -> list[tuple[str | None, str]]:
    """(key, error) of the keys that ``made`` fails for.

    ``try_to_binary`` has no value where its argument cannot be computed, which one pass over
    all rows shows. The rows in question are staged, few to a file; the error of each key
    takes a job of its own that reads one file.
    """
    spark = rows.sparkSession
    ready = made(rows)
    value = F.try_to_binary(F.xxhash64(*ready.columns).cast("string"), F.lit("utf-8"))
    keys = stage(ready.select(key, value.isNull().alias("fails")).where("fails").select(
        F.col(key).alias(PLACE)).distinct(), "suspect-keys")
    places = max(1, -(-keys.count() // PLACE_KEYS))
    found = rows.join(keys, F.col(key).eqNullSafe(F.col(PLACE)), "left_semi").withColumn(
        PLACE, F.pmod(F.xxhash64(key), F.lit(places)).cast("int"))
    path = new_staging_path(spark, "suspects")
    found.repartition(PLACE).write.partitionBy(PLACE).parquet(path)
    suspects = spark.read.schema(found.schema).parquet(path)
    ready = made(suspects)

    def alone(row) -> tuple[str | None, str] | None:
        own, place = row
        one = ready.where((F.col(PLACE) == place) & F.col(key).eqNullSafe(F.lit(own)))
        try:
            one.write.format("noop").mode("overwrite").save()
        except Exception as error:
            return own, error_text(error)

    each = suspects.select(key, PLACE).distinct().collect()
    return [failure for failure in pool.map(alone, each) if failure]


def write_guarded(rows: DataFrame, key: str, write: Callable[[DataFrame, str], None],
                  counts: dict[str, Column],
                  finish: Callable[[DataFrame], DataFrame] = lambda rows: rows,
                  made: Callable[[DataFrame], DataFrame] | None = None) -> Written:
    """Write ``finish(rows)``; on a failure, everything but the keys that make it fail.

    ``write`` gets a DataFrame and the name of a piece, to be written to a place of its own, since
    pieces are written side by side; it leaves nothing behind when it fails. The whole is tried
    first. If it fails, ranges of the key's hash are halved, several at a time,
    until the failing keys stand alone: their (key, error) are returned. Each failing key costs a
    number of jobs that grows with the logarithm of the rows, and each job reads the rows' source.
    A failure that an empty write has as well is not a matter of rows, and is raised.

    With ``made``, which adds columns to rows one by one, ``finish(made(rows))`` is written, and
    ``rows`` themselves must not fail. Then one pass finds the rows that ``made`` fails for, each
    of their keys costs one small job that reads only a few rows, and all others are written at
    once; what fails for other reasons is halved as above.

    ``counts`` are aggregates over the rows of a piece before ``finish``, taken as they pass.
    """
    ready = made or (lambda rows: rows)

    def attempt(part: DataFrame, name: str) -> dict[str, int]:
        seen = Observation()
        observed = ready(part).observe(seen, *(c.alias(n) for n, c in counts.items()))
        write(finish(observed), name)
        return seen.get

    def outcome(part: DataFrame, name: str):
        try:
            return attempt(part, name), None
        except Exception as error:
            return None, error

    result = Written()
    counted, error = outcome(rows, "whole")
    if error is None:
        result.add(counted)
        return result
    write(finish(ready(rows.limit(0))), "empty")
    pieces = [_Piece()]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        if made is not None:
            rows = stage(rows, "guarded")
            try:
                result.failed += _failures(rows, key, made, pool)
            except Exception as fault:
                # Not even that pass gets through; halving does without it.
                logger.warning("failing rows are not found in one pass: %s", error_text(fault))
            if result.failed:
                out = rows.sparkSession.createDataFrame(
                    [(k,) for k, _ in result.failed], T.StructType([
                        T.StructField(PLACE, rows.schema[key].dataType)]))
                # Staged, or a filter of ``finish`` might reach the failing rows before this join.
                rows = result.rows = stage(rows.join(
                    F.broadcast(out), F.col(key).eqNullSafe(F.col(PLACE)), "left_anti"), "sound")
                counted, error = outcome(rows, "sound")
                if error is None:
                    result.add(counted)
                    return result

        def tried(piece: _Piece):
            # That the whole fails is known.
            found = outcome(piece.of(rows, key), piece.name) if piece.depth else (None, error)
            return piece, *found

        while pieces:
            following = []
            for piece, counted, fault in pool.map(tried, pieces):
                if fault is None:
                    result.add(counted)
                    continue
                keys = piece.of(rows.select(key), key).distinct().limit(2).collect()
                if len(keys) > 1 and piece.depth < MAX_DEPTH:
                    following += piece.halves()
                else:
                    result.failed += [(r[0], error_text(fault)) for r in keys]
            pieces = following
    return result
