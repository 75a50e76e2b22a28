"""Importance resampling towards a target text distribution.

Hashed word runs of the documents and of the target give every bucket a gain; a document
weighs the sum of its gains, read from one array. A Gumbel variate from its id is added, and
the highest scores are drawn without replacement. Ranks come from parallel sorting by
regular sampling: runs are sorted where they are, regular places of all runs give splitters,
slices of runs between two splitters meet and are merged, and the counts of earlier
segments turn places into ranks.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpipe.llm.common import stage, table

BUCKETS = 10_000
#: Words of a feature, from and to.
RUNS = (1, 1)
#: Words a document must have to be drawn, and percent of those documents that are drawn.
LEAST_WORDS, PERCENT = 20, 10
SEED = "2024"
#: Rows a task sorts at once, rows of a merged segment, about, and segments at most.
RUN_ROWS, SEGMENT_ROWS, SEGMENTS = 1 << 17, 1 << 14, 1 << 15
#: Samples a segment's splitter is chosen from.
OVERSAMPLING = 16
#: Words whose bucket a task remembers.
KNOWN_WORDS = 1 << 19

# A-Z become a-z; ASCII that is neither letter nor digit becomes a space. All bytes of
# other characters belong to words.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20
    for c in range(256))


class _Buckets(dict):
    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


@dataclass(frozen=True)
class Features:
    """How a text becomes buckets: runs of ``low`` to ``high`` words, hashed."""

    buckets: int = BUCKETS
    low: int = RUNS[0]
    high: int = RUNS[1]

    def reader(self):
        """A function from UTF-8 text (None: no words) to (number of words, bucket array)."""
        known = _Buckets(self.buckets)

        def read(text: bytes | None) -> tuple[int, np.ndarray]:
            words = (text or b"").translate(_FOLD).split()
            features = []
            for n in range(self.low, self.high + 1):
                features += words if n == 1 else (
                    b" ".join(words[k:k + n]) for k in range(len(words) - n + 1))
            found = np.fromiter(map(known.__getitem__, features), np.int32, len(features))
            return len(words), found

        return read


def bucket_counts(texts: DataFrame, features: Features = Features()) -> np.ndarray:
    """Features of all texts per bucket; a task sends one row per bucket it saw."""
    def count(batches) -> Iterator[pa.RecordBatch]:
        read = features.reader()
        total = np.zeros(features.buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                total += np.bincount(read(text.as_py())[1], minlength=features.buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    parts = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(
        count, "bucket int, n bigint")
    out = np.zeros(features.buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares in target and source, per bucket."""
    size = len(source)
    s_all, t_all = int(source.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log(
            (float(t) + 1) * (float(s_all) + size) / ((float(s) + 1) * (float(t_all) + size))))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def luck(key: str) -> int:
    """The Gumbel variate of a key in steps of 1/1000, from its hash alone."""
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, features: Features = Features(),
           seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        read = features.reader()
        for batch in batches:
            rows = []
            for name, text in zip(batch.column("name"), batch.column("text"), strict=True):
                n_words, found = read(text.as_py())
                weight = int(gain[found].sum())
                rows.append((n_words, len(found), weight,
                             weight + luck(f"{seed}:{name.as_py()}")))
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, columns)],
                ["doc_id", "n_words", "n_features", "weight", "score"])

    doc_id = F.col("doc_id")
    return docs.select(
        "doc_id", F.coalesce(doc_id.cast("string"), F.lit("")).alias("name"),
        F.col("text").cast("binary").alias("text"),
    ).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, "
                      "n_features bigint, weight bigint, score bigint")


# Columns of a row that is sorted, in the order of their weight: higher scores first, then
# smaller ids, NULL ids last. Repeated rows are told apart by their run, so that many copies
# of one row need not meet in one segment.
_SORTED = ("score", "no_id", "doc_id", "n_features", "weight", "run")


def _order(columns: list[np.ndarray]) -> np.ndarray:
    return np.lexsort(columns[::-1])


def _packed(arrays: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([a.astype("<i8").tobytes()], pa.binary()) for a in arrays]


def _unpacked(values) -> list[np.ndarray]:
    return [np.frombuffer(v.as_py(), "<i8") for v in values]


_PACK = ", ".join(f"{c} binary" for c in _SORTED)


def sorted_runs(rows: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per run: its length and its sorted columns as packed int64.

    A run has ``run_rows`` rows at most and is sorted in the task that reads it.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        numbers = itertools.count(TaskContext.get().partitionId() << 32)

        def handed():
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("doc_id").combine_chunks()
            columns = [-table.column("score").to_numpy(), np.asarray(ids.is_null()).astype(np.int64),
                       ids.fill_null(0).to_numpy(), table.column("n_features").to_numpy(),
                       table.column("weight").to_numpy(),
                       np.full(table.num_rows, next(numbers), np.int64)]
            order = _order(columns)
            return pa.RecordBatch.from_arrays(
                [pa.array([len(order)], pa.int64()), *_packed([c[order] for c in columns])],
                ["n", *_SORTED])

        for batch in batches:
            for at in range(0, batch.num_rows, run_rows):
                piece = batch.slice(at, run_rows)
                if size + piece.num_rows > run_rows:
                    yield handed()
                    held, size = [], 0
                if piece.num_rows:
                    held.append(piece)
                    size += piece.num_rows
        if size:
            yield handed()

    return rows.select("doc_id", "n_features", "weight", "score").mapInArrow(
        run, f"n bigint, {_PACK}")


def splitters(runs: DataFrame, rows: int, segment_rows: int = SEGMENT_ROWS) -> np.ndarray:
    """Keys between segments: every OVERSAMPLING-th of the regular samples of all runs.

    Each run gives the rows at every ``step``-th place, so the driver gets
    SEGMENTS x OVERSAMPLING samples at most, and no segment can exceed its share by more
    than one step per run.
    """
    segments = min(SEGMENTS, -(-rows // segment_rows))
    if segments < 2:
        return np.empty((len(_SORTED), 0), np.int64)
    step = max(1, rows // (segments * OVERSAMPLING))

    def sample(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                columns = _unpacked([batch.column(c)[k] for c in _SORTED])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[step - 1::step]) for c in columns], list(_SORTED))

    found = runs.select(*_SORTED).mapInArrow(
        sample, ", ".join(f"{c} bigint" for c in _SORTED)).toArrow()
    columns = [found.column(c).to_numpy() for c in _SORTED]
    order = _order(columns)[OVERSAMPLING - 1::OVERSAMPLING][:segments - 1]
    return np.stack([c[order] for c in columns])


def _edges(columns: list[np.ndarray], keys: np.ndarray) -> list[int]:
    """Where a sorted run is cut: behind its rows that do not come after each key."""
    n = len(columns[0])
    # The sort is stable, so a key lands behind the rows equal to it.
    order = _order([np.concatenate(both) for both in zip(columns, keys, strict=True)])
    behind = np.flatnonzero(order >= n) - np.arange(keys.shape[1])
    return [0, *behind.tolist(), n]


def segments_of(runs: DataFrame, keys: np.ndarray) -> DataFrame:
    """Slices of runs between the splitters: (segment, n, packed columns)."""
    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                columns = _unpacked([batch.column(c)[k] for c in _SORTED])
                edges = _edges(columns, keys)
                slices = [(segment, low, high) for segment, (low, high) in enumerate(
                    zip(edges, edges[1:], strict=False)) if low < high]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _, _ in slices], pa.int32()),
                     pa.array([high - low for _, low, high in slices], pa.int64()),
                     *(pa.array([c[low:high].tobytes() for _, low, high in slices], pa.binary())
                       for c in columns)], ["segment", "n", *_SORTED])

    return runs.select(*_SORTED).mapInArrow(cut, f"segment int, n bigint, {_PACK}")


def _merged(columns: list[np.ndarray], kind: pa.DataType, before: int | None,
            drawn: int) -> dict[str, pa.Array]:
    score, no_id, doc_id, n_features, weight, _ = columns
    ids = pa.array(doc_id, mask=no_id.astype(bool)).cast(kind)
    places = np.arange(1, len(score) + 1) + (before or 0)
    rank = pa.array(places, mask=np.full(len(places), True) if before is None else places > drawn)
    return {"doc_id": ids, "n_features": pa.array(n_features), "weight": pa.array(weight),
            "score": pa.array(-score), "rank": rank}


def ranked(rows: DataFrame, percent: int = PERCENT, run_rows: int = RUN_ROWS,
           segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: the highest floor(percent N / 100) of N rows
    have ranks 1, 2, ..., the others NULL.

    Only segments that hold drawn rows are merged, one per group; the rest is unpacked
    where it lies.
    """
    runs = stage(sorted_runs(rows, run_rows), "sorted-runs")
    total = runs.agg(F.sum("n")).first()[0] or 0
    drawn = percent * total // 100
    slices = stage(segments_of(runs, splitters(runs, total, segment_rows)), "run-slices")
    before, seen = {}, 0
    for row in slices.groupBy("segment").agg(F.sum("n").alias("n")).orderBy("segment").collect():
        if seen < drawn:
            before[row.segment] = seen
        seen += row.n
    field = rows.schema["doc_id"].dataType.simpleString()
    kind = pa.int32() if field == "int" else pa.int64()
    schema = f"doc_id {field}, n_features bigint, weight bigint, score bigint, rank bigint"

    def merge(group: pa.Table) -> pa.Table:
        columns = [np.concatenate(_unpacked(group.column(c))) for c in _SORTED]
        order = _order(columns)
        segment = group.column("segment")[0].as_py()
        return pa.table(_merged([c[order] for c in columns], kind, before[segment], drawn))

    def unpack(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                columns = _unpacked([batch.column(c)[k] for c in _SORTED])
                yield pa.RecordBatch.from_pydict(_merged(columns, kind, None, 0))

    last = max(before, default=-1)
    first = slices.where(F.col("segment") <= last).groupBy("segment").applyInArrow(merge, schema)
    return first.unionByName(slices.where(F.col("segment") > last).mapInArrow(unpack, schema))


def resample(docs: DataFrame, target: DataFrame, *, features: Features = Features(),
             least_words: int = LEAST_WORDS, percent: int = PERCENT,
             seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``.

    NULL and empty texts have no features, weight 0 and are never drawn. Rows with equal
    scores are ranked by doc_id, NULL ids (which hash like an empty id) last; every
    copy of a repeated row is a row of its own. With an empty target all its counts are
    0; empty ``docs`` give no row.
    Other columns are ignored, whatever their names.
    """
    gain = gains(bucket_counts(docs, features), bucket_counts(target, features))
    rows = stage(scored(docs, gain, features, seed), "scored")
    long_enough = F.col("n_words") >= least_words
    short = rows.where(~long_enough).select(
        "doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    return ranked(rows.where(long_enough), percent).unionByName(short)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
