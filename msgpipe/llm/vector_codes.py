"""Vector codes: each part of a vector is replaced by its nearest codebook entry.

The codebooks are refined in rounds. Between rounds a vector keeps, for every group of
entries, the distance to the nearest of them and the round it was measured in. All
codebooks of earlier rounds are kept too, so a bound is lowered by what an entry
has moved on balance since that round, which is never more than the sum of its steps. Only
groups whose bound does not keep them behind the vector's own entry are measured
again. All distances and codes are those of whole scans, in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpipe.llm.common import table
from msgpipe.session import new_staging_path, remove

#: Steps of a component, parts of a vector, entries of a codebook (256 at most) and rounds.
STEPS, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Groups of entries that share a bound.
GROUPS = 8
#: Rows compared with a codebook at once.
STRIP = 2048
#: What rounding may do to a bound, relative to the distances involved.
_SLACK = 1e-6


@dataclass(frozen=True)
class Codebooks:
    """Entries of every part, for every round so far, the latest last."""

    cuts: tuple[int, ...]
    history: tuple[tuple[np.ndarray, ...], ...]

    @property
    def latest(self) -> tuple[np.ndarray, ...]:
        return self.history[-1]

    @classmethod
    def of(cls, vectors: np.ndarray, parts: int) -> Codebooks:
        sizes = [len(p) for p in np.array_split(np.arange(vectors.shape[1]), parts)]
        cuts = tuple(np.cumsum([0, *sizes]).tolist())
        books = cls(cuts, ())
        return replace(books, history=(tuple(books.parts_of(vectors)),))

    def parts_of(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [vectors[:, a:b] for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def then(self, entries: tuple[np.ndarray, ...]) -> Codebooks:
        return replace(self, history=(*self.history, entries))

    def digest(self) -> str:
        numbers = ",".join(str(x) for part in self.latest for x in part.ravel().tolist())
        return hashlib.sha256(numbers.encode()).hexdigest()


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    top = max(int(np.abs(a).max(initial=0)) for a in (x, entries))
    if 4 * top * top * max(1, x.shape[1]) < 1 << 52:
        # Doubles hold every sum exactly, and their products are fast.
        a, b = x.astype(np.float64), entries.astype(np.float64)
        found = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
        return found.astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for k, entry in enumerate(entries):
        out[:, k] = ((x - entry) ** 2).sum(1)
    return out


@dataclass
class State:
    """Per vector of one part: its entry, and per group a distance and the round it is from."""

    code: np.ndarray
    bound: np.ndarray
    stamp: np.ndarray

    @classmethod
    def unknown(cls, n: int, groups: int) -> State:
        """Nothing measured yet: a bound below zero keeps no group behind."""
        return cls(np.zeros(n, np.uint8), np.full((n, groups), -1, np.float32),
                   np.zeros((n, groups), np.uint8))


def assign(x: np.ndarray, states: State, history: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Bring codes and bounds up to the latest entries; (squared distances, groups measured)."""
    now, entries = len(history) - 1, history[-1]
    code, bound, stamp = states.code, states.bound, states.stamp
    groups = np.array_split(np.arange(len(entries)), bound.shape[1])
    own = ((x - entries[code]) ** 2).sum(1)
    before = code.copy()
    home = np.zeros(len(entries), np.int64)
    moved = np.zeros((now + 1, len(groups)))
    for g, members in enumerate(groups):
        home[members] = g
        for then in range(now + 1):
            steps = (entries[members] - history[then][members]).astype(np.float64)
            moved[then, g] = np.sqrt((steps * steps).sum(1)).max(initial=0)
    # The group of a vector's own entry holds the bound of the others in it.
    reach = bound - moved[stamp, np.arange(len(groups))[None, :]]
    open_ = ~(np.sqrt(own)[:, None] * (1 + _SLACK) < reach * (1 - _SLACK))
    best = own.copy()
    measured: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def measure(g: int, rows: np.ndarray) -> None:
        nonlocal best
        found = squares(x[rows], entries[groups[g]])
        nearest = found.argmin(1)
        distance, entry = found[np.arange(len(rows)), nearest], groups[g][nearest]
        better = (distance < best[rows]) | ((distance == best[rows]) & (entry < code[rows]))
        best[rows[better]] = distance[better]
        code[rows[better]] = entry[better]
        measured[g] = (rows, found)

    total = 0
    for g in range(len(groups)):
        rows = np.flatnonzero(open_[:, g])
        if len(rows):
            measure(g, rows)
            total += len(rows)
    # An entry that was left is no longer the own one, so its group needs a bound with it.
    left = (before != code) & ~open_[np.arange(len(x)), home[before]]
    for g in np.unique(home[before[left]]):
        rows = np.flatnonzero(left & (home[before] == g))
        found = squares(x[rows], entries[groups[g]])
        total += len(rows)
        _keep(states, g, rows, found, groups[g], now)
    for g, (rows, found) in measured.items():
        _keep(states, g, rows, found, groups[g], now)
    return best, total


def _keep(states: State, g: int, rows: np.ndarray, found: np.ndarray, members: np.ndarray,
          now: int) -> None:
    """Store the distance to the nearest entry of a group but the own one, rounded down."""
    others = np.where(members[None, :] == states.code[rows][:, None], np.iinfo(np.int64).max, found)
    least = np.sqrt(others.min(1).astype(np.float64)).astype(np.float32)
    states.bound[rows, g] = np.nextafter(least, np.float32(0))
    states.stamp[rows, g] = now


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of an array."""
    data = np.ascontiguousarray(rows)
    width = data.itemsize * int(np.prod(data.shape[1:]))
    ends = np.arange(len(data) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(
        pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])


def _rows(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def whole_vectors(embeddings: DataFrame, steps: int = STEPS) -> DataFrame:
    """vec_id, label, size, v: components as floor(steps x) in packed int64.

    Rows whose vector is NULL or holds NULL or non-finite components are left out. A
    component whose square would not leave room for a sum in 64 bits is an error.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            flat = lists.flatten()
            good = np.asarray(lists.is_valid())
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
            bad = ~np.isfinite(values)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            good &= np.bincount(owner[bad], minlength=len(sizes)) == 0
            whole = np.floor(np.where(np.isfinite(values), values, 0.0) * steps)
            kept = np.flatnonzero(good)
            limit = np.sqrt(2.0 ** 61 / np.maximum(sizes, 1))
            if (np.abs(whole) > limit[owner])[good[owner]].any():
                raise ValueError("a vector component is too large for whole squared distances")
            whole = whole.astype(np.int64)
            ends = np.cumsum(sizes)
            packed = [whole[ends[k] - sizes[k]:ends[k]].tobytes() for k in kept]
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(at), batch.column("label").take(at),
                 pa.array(sizes[kept].astype(np.int32)), pa.array(packed, pa.binary())],
                ["vec_id", "label", "size", "v"])

    types = dict(embeddings.dtypes)
    return embeddings.select("vec_id", "label", "embedding").mapInArrow(run, (
        f"vec_id {types['vec_id']}, label {types['label']}, size int, v binary"))


def _write(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = rows.sparkSession
    path = new_staging_path(spark, name)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def _strips(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, STRIP):
        yield batch.slice(at, STRIP)


def assigned(rows: DataFrame, books: Codebooks, size: int) -> DataFrame:
    """Vectors with codes, bounds and stamps brought up to the latest codebooks, and ``error``.

    Rows without state yet are measured whole. ``measured`` counts (part, group) scans.
    """
    parts, entries = len(books.latest), len(books.latest[0])
    groups = min(GROUPS, entries)
    fresh = "codes" not in rows.columns
    histories = [[book[p] for book in books.history] for p in range(parts)]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for strip in _strips(batch):
                yield one(strip)

    def one(strip: pa.RecordBatch) -> pa.RecordBatch:
        n = strip.num_rows
        x = _rows(strip.column("v"), "<i8", size)
        if fresh:
            states = [State.unknown(n, groups) for _ in range(parts)]
        else:
            codes, bounds, stamps = (
                _rows(strip.column(c), kind, parts, *shape) for c, kind, shape in (
                    ("codes", "u1", ()), ("bounds", "<f4", (groups,)), ("stamps", "u1", (groups,))))
            states = [State(*(a[:, p].copy() for a in (codes, bounds, stamps)))
                      for p in range(parts)]
        error, measured = np.zeros(n, np.int64), 0
        for part, state, history in zip(books.parts_of(x), states, histories, strict=True):
            squared, scans = assign(part, state, history)
            error += squared
            measured += scans
        counted = np.zeros(n, np.int64)
        counted[:1] = measured
        return pa.RecordBatch.from_arrays(
            [*(strip.column(c) for c in ("vec_id", "label", "v")),
             *(_binary(np.stack([getattr(s, a) for s in states], 1))
               for a in ("code", "bound", "stamp")), pa.array(error), pa.array(counted)],
            ["vec_id", "label", "v", "codes", "bounds", "stamps", "error", "measured"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, (
        f"vec_id {types['vec_id']}, label {types['label']}, v binary, codes binary, "
        "bounds binary, stamps binary, error bigint, measured bigint"))


def refined(rows: DataFrame, books: Codebooks, size: int) -> Codebooks:
    """Codebooks of the floored means of their parts; entries without a part stay.

    A task sums its vectors and sends each sum once; the driver gets one number per
    component of the codebooks.
    """
    parts, entries = len(books.latest), len(books.latest[0])
    width = size + parts

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros((entries, width), np.int64)
        for batch in batches:
            for strip in _strips(batch):
                x = _rows(strip.column("v"), "<i8", size)
                codes = _rows(strip.column("codes"), "u1", parts)
                for p, part in enumerate(books.parts_of(x)):
                    np.add.at(total[:, books.cuts[p]:books.cuts[p + 1]], codes[:, p], part)
                    total[:, size + p] += np.bincount(codes[:, p], minlength=entries)
        flat = total.ravel()
        seen = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(flat[seen])], ["place", "s"])

    sums = np.zeros(entries * width, np.int64)
    found = rows.select("v", "codes").mapInArrow(run, "place bigint, s bigint")
    for row in found.groupBy("place").agg(F.sum("s").alias("s")).collect():
        sums[row.place] = row.s
    sums = sums.reshape(entries, width)
    new = []
    for p, old in enumerate(books.latest):
        count = sums[:, size + p][:, None]
        mean = sums[:, books.cuts[p]:books.cuts[p + 1]] // np.maximum(count, 1)
        new.append(np.where(count > 0, mean, old))
    return books.then(tuple(new))


def _coded(vectors: DataFrame, size: int, parts: int, entries: int, rounds: int) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of all vectors of one length."""
    spark = vectors.sparkSession
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.frombuffer(b"".join(bytes(r.v) for r in first), "<i8").reshape(len(first), size)
    books = Codebooks.of(start, parts)
    rows, held = vectors.drop("size"), None
    for _ in range(rounds):
        rows, path = _write(assigned(rows, books, size), "vector-codes")
        if held:
            # The rows written last hold all that these held.
            remove(spark, held)
        held = path
        books = refined(rows, books, size)
    last, _ = _write(assigned(rows, books, size).select(
        "vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error"), "vector-codes")
    if held:
        remove(spark, held)
    return last.withColumn("codebooks_sha256", F.lit(books.digest()))


def encode_vectors(embeddings: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES,
                   rounds: int = ROUNDS, steps: int = STEPS) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of every vector that can be coded.

    Vectors that are NULL or hold NULL or non-finite components have no row. Every copy of
    a repeated row is coded and counts in the means. NULL ids come after all others when
    the first entries are chosen, equal ids are ordered by their vectors. With
    fewer vectors than entries there are as many entries as vectors. Lengths that parts do
    not divide give the first parts one component more. Vectors of different lengths have codebooks of
    their own; there should be few lengths, since each is a run of jobs. Other columns
    are ignored, whatever their names.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    vectors, path = _write(whole_vectors(embeddings, steps), "whole-vectors")
    found = None
    for (size,) in vectors.select("size").distinct().orderBy("size").collect():
        coded = _coded(vectors.where(F.col("size") == size), size, parts, entries, rounds)
        found = coded if found is None else found.unionByName(coded)
    if found is None:
        return vectors.select("vec_id", "label", F.lit("").alias("code"),
                              F.lit(0).cast("bigint").alias("error"),
                              F.lit("").alias("codebooks_sha256"))
    remove(embeddings.sparkSession, path)
    return found


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the errors of all rows with the same label, NULL labels together."""
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that can be coded."""
    coded = encode_vectors(table(spark, sf_dir, "embeddings"))
    return with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")
