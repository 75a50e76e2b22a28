"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are turned to their principal axes, so the leading coordinates carry most
of every product. Tiles along the first axis are compared pairwise: products of the
leading coordinates come first, the rest is bounded by the product of suffix norms, and
only pairs that can still reach the threshold are finished, in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpipe.llm.common import components, in_arrow, stage, table
THRESHOLD = 0.9
#: Vectors of a tile, about. A task holds two tiles.
TILE = 4096
#: Rows of a tile that are compared with another tile at once.
STRIP = 256
#: Leading coordinates of each step; the rest follows for the pairs left.
STEPS = (12, 28)
_SLACK = 1e-9


def different_vectors(embeddings: DataFrame) -> DataFrame:
    """(id, n, embedding): each different usable vector, its smallest vec_id and its rows."""
    e = F.col("embedding").cast("array<double>")
    usable = (F.size(e) > 0) & F.forall(
        e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists(e, lambda x: x != 0)
    return embeddings.where("embedding is not null").where(usable).groupBy("embedding").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, size)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(vectors: DataFrame, size: int) -> np.ndarray:
    """Axes by decreasing second moment, from sums of all unit vectors (size x size numbers)."""
    def make():
        def convert(batch):
            x = _unit(_matrix(batch.column("embedding"), size))
            sums = (x.T @ x).ravel()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(sums))), pa.array(sums)], ["place", "s"])
        return convert

    sums = in_arrow(vectors.select("embedding"), make, "place bigint, s double")
    moment = np.zeros(size * size)
    for row in sums.groupBy("place").agg(F.sum("s").alias("s")).collect():
        moment[row.place] = row.s
    values, axes = np.linalg.eigh(moment.reshape(size, size))
    return np.ascontiguousarray(axes[:, np.argsort(-values)])


def _local_classes(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` points reaches over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(left: np.ndarray, right: np.ndarray, axes: np.ndarray, threshold: float,
            same: bool):
    """Links (i, j) between two blocks of unit vectors, strip by strip; i < j if ``same``."""
    a, b = left @ axes, right @ axes
    cuts = [min(c, a.shape[1]) for c in STEPS]
    tails = [(np.sqrt((a[:, c:] ** 2).sum(1)), np.sqrt((b[:, c:] ** 2).sum(1))) for c in cuts]
    for at in range(0, len(a), STRIP):
        rows = slice(at, at + STRIP)
        bound = a[rows, :cuts[0]] @ b[:, :cuts[0]].T
        bound += np.multiply.outer(tails[0][0][rows], tails[0][1])
        i, j = np.nonzero(bound >= threshold - _SLACK)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for piece in range(0, len(i), 1 << 18):
            p, q = i[piece:piece + (1 << 18)], j[piece:piece + (1 << 18)]
            lead = np.einsum("ij,ij->i", a[p, :cuts[1]], b[q, :cuts[1]])
            open_ = lead + tails[1][0][p] * tails[1][1][q] >= threshold - _SLACK
            p, q = p[open_], q[open_]
            good = np.einsum("ij,ij->i", left[p], right[q]) >= threshold
            if good.any():
                yield p[good], q[good]


def _tile_links(vectors: DataFrame, size: int, threshold: float) -> DataFrame:
    """(id, root, links): per tile pair and vector, a vector it is connected with and its links."""
    axes = principal_axes(vectors, size)
    first = axes[:, 0]

    def place():
        def convert(batch):
            x = _unit(_matrix(batch.column("embedding"), size))
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n"), batch.column("embedding"),
                 pa.array(x @ first)], ["id", "n", "embedding", "lead"])
        return convert

    types = dict(vectors.dtypes)
    placed = stage(in_arrow(vectors, place, (
        f"id {types['id']}, n bigint, embedding {types['embedding']}, lead double")), "placed")
    tiles = 1 + placed.count() // TILE
    edges = placed.approxQuantile("lead", [k / tiles for k in range(1, tiles)],
                                  1 / (8 * tiles)) if tiles > 1 else []
    edges = sorted(set(edges))
    tile = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"),
                           lambda e: e <= F.col("lead"))) if edges else F.lit(0)
    # Unit vectors of cosine >= t differ by sqrt(2 - 2t) at most along any axis.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _SLACK
    last = [int(np.searchsorted(edges, (edges[k] if k < len(edges) else np.inf) + reach, "right"))
            for k in range(len(edges) + 1)]

    def pack_tile(rows: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        kept = rows.select(["id", "n", "embedding"])
        with pa.ipc.new_stream(sink, kept.schema) as out:
            out.write_table(kept)
        return pa.table({"tile": rows.column("tile")[:1].cast(pa.int32()),
                         "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    packed = stage(placed.withColumn("tile", tile).groupBy("tile").applyInArrow(
        pack_tile, "tile int, data binary"), "tiles")
    partners = F.sequence(F.col("tile"), F.element_at(
        F.array(*map(F.lit, last)), F.col("tile") + 1))
    pairs = packed.select(F.col("tile").alias("i"), F.explode(partners).alias("tile"), F.col(
        "data").alias("left")).join(packed, "tile").select("i", F.col("tile").alias("j"), "left",
                                                           F.col("data").alias("right"))

    def run(batches):
        for batch in batches:
            for i, j, left, right in zip(*(batch.column(c) for c in ("i", "j", "left", "right")),
                                         strict=True):
                yield from one(i.as_py() == j.as_py(), left.as_py(), right.as_py())

    def one(same: bool, left: bytes, right: bytes):
        blocks = [pa.ipc.open_stream(data).read_all().combine_chunks() for data in (left, right)]
        ids = pa.concat_arrays([b.column("id").combine_chunks() for b in blocks])
        x, y = (_unit(_matrix(b.column("embedding").combine_chunks(), size)) for b in blocks)
        n, m = (b.column("n").to_numpy() for b in blocks)
        shift = 0 if same else len(x)
        total = np.zeros(len(ids), np.int64)
        label = np.arange(len(ids))
        for p, q in compare(x, y, axes, threshold, same):
            np.add.at(total, p, m[q])
            np.add.at(total, q + shift, n[p])
            # Connected points need no further link: classes grow strip by strip.
            label = _local_classes(len(label), np.r_[np.arange(len(label)), p],
                                   np.r_[label, q + shift])
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(some)), ids.take(pa.array(label[some])),
                 pa.array(total[some])], ["id", "root", "links"])

    return pairs.repartition("i", "j").mapInArrow(
        run, f"id {types['id']}, root {types['id']}, links bigint")


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id) of every row: other rows of cosine >= ``threshold``.

    Links are found between different vectors; equal vectors, however many, are
    compared once and counted by their number. NULL, empty or zero vectors and those
    with NULL or non-finite components link with nothing, nor do vectors of different
    lengths with each other. Every row keeps its own row; rows of one vec_id that link
    count each other. A row with a NULL vec_id links as any other and is never the
    smallest. Other columns are ignored.
    """
    vectors = stage(different_vectors(embeddings).withColumn("size", F.size("embedding"))
                    .withColumn("id", F.col("id").cast("bigint")), "vectors")
    # Vectors whose rows all lack an id get one beyond all others, and lose it in the end.
    top, lone = vectors.agg(F.coalesce(F.max("id"), F.lit(0)), F.count_if(F.col("id").isNull())).first()
    if lone:
        vectors = stage(vectors.withColumn("id", F.coalesce(
            "id", F.lit(top + 1) + F.monotonically_increasing_id())), "vectors")
    found = None
    for (size,) in vectors.select("size").distinct().collect():
        links = _tile_links(vectors.where(F.col("size") == size).drop("size"), size, threshold)
        found = links if found is None else found.unionByName(links)
    if found is None:
        return embeddings.select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                                 F.col("vec_id").alias("component_id"))
    found = stage(found, "vector-links")
    classes = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    judged = (
        vectors.join(counts, "id", "left")
        .join(classes.select(F.col("node").alias("id"), "component"), "id", "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("component_id")))
    judged = judged.withColumn("component_id", F.when(F.col("component_id") <= top, F.col(
        "component_id")).cast(embeddings.schema["vec_id"].dataType))
    return embeddings.select("vec_id", "embedding").join(judged, "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))


def op5_embedding_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumn(
        "kept", F.col("vec_id") == F.col("component_id"))
