"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from msgpipe.functions.text import let
from msgpipe.session import new_staging_path, remove

#: Deletes the shuffle files of a statement when it ends, not when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Neighbours in sorted order that are linked before whole buckets are compared.
NEAREST = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(rows: DataFrame, name: str) -> DataFrame:
    """Write rows once to the shared folder and read them back: cuts lineage for good.

    The shuffles of the write serve nothing else, so Spark deletes their files at its end.
    """
    spark = rows.sparkSession
    path = new_staging_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        rows.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    found = spark.read.schema(rows.schema).parquet(path)
    found.staged_path = path
    return found


def unstage(*staged: DataFrame) -> None:
    """Delete staged tables whose rows have been written on; they cannot be read any more."""
    for rows in staged:
        remove(rows.sparkSession, rows.staged_path)


def in_arrow(rows: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
             schema: str) -> DataFrame:
    """``mapInArrow`` with a function that ``make`` builds once per task."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = make()
        for batch in batches:
            yield convert(batch)

    return rows.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; NULL counts as the empty text."""
    return [value or "" for value in batch.column(column).to_pylist()]


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def shared(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; none if both are empty."""
    def ratio(both: Column) -> Column:
        common = F.size(F.array_intersect(both["x"], both["y"]))
        return common / (F.size(both["x"]) + F.size(both["y"]) - common)

    return let(F.struct(x.alias("x"), y.alias("y")), ratio)


def near(first: Column, second: Column, bits: int) -> Column:
    """Two 64-bit fingerprints differ in at most ``bits`` places."""
    return F.bit_count(first.bitwiseXOR(second)) <= bits


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges
    form stars; each step is staged, so lineage stays short. Minima combine before
    the shuffle and a node of very many neighbours meets a single row in the joins,
    which lets AQE split it. Nodes without an edge have no row.
    """
    now = stage(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while (mark := now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()) != before:
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v > m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        small = stage(least.select("u", F.col("m").alias("v")).unionByName(moved).distinct(),
                      "small-star")
        unstage(large, now)
        now = small
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def contracted(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (node, component), each node once, joined along further links (a, b) of nodes.

    Only the links between classes are followed, and there are few of them.
    """
    ends = [classes.select(F.col("node").alias(x), F.col("component").alias(f"{x}_of"))
            for x in ("a", "b")]
    between = stage(links.join(ends[0], "a").join(ends[1], "b").select(
        F.col("a_of").alias("a"), F.col("b_of").alias("b")).where("a <> b").distinct(), "class-links")
    if between.isEmpty():
        return classes
    joined = components(between).select(
        F.col("node").alias("component"), F.col("component").alias("joined"))
    return classes.join(joined, "component", "left").select(
        "node", F.coalesce("joined", "component").alias("component"))


def crowded(members: DataFrame, bucket: list[str], order: str) -> DataFrame:
    """Members of buckets with two members at least, beside their nearest in sorted order.

    One shuffle and a streaming window; ``near_1`` ... are the members before this
    one in its bucket and ``first`` the bucket's first, all with the row's own columns.
    """
    window = Window.partitionBy(*bucket).orderBy(order)
    whole = F.struct(*(c for c in members.columns if c not in bucket))
    ranked = members.select(
        "*", *(F.lag(whole, k).over(window).alias(f"near_{k}") for k in range(1, NEAREST + 1)),
        F.first(whole).over(window).alias("first"), F.lead(F.lit(1)).over(window).alias("after"))
    return ranked.where("near_1 is not null or after is not null").drop("after")


def nearest_pairs(crowd: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) of structs: each crowded member with its nearest and its bucket's first."""
    others = F.array(*(f"near_{k}" for k in range(1, NEAREST + 1)), "first")
    return (
        crowd.select(F.struct(*columns).alias("a"), F.explode(others).alias("b"))
        .where("b is not null and a <> b").distinct()
    )


def with_component(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Rows with the component of ``key``; a row without links is its own component."""
    named = found.select(F.col("node").alias(key), F.col("component").alias("found"))
    return rows.join(named, key, "left").withColumn(
        "component", F.coalesce("found", key)).drop("found")


def cross_pairs(members: DataFrame, bucket: list[str], columns: list[str],
                keep: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs of a bucket that lie in different components and that ``keep`` accepts, as (a, b).

    ``a`` and ``b`` are values of the first of the ``columns``, the smaller one first, each pair once.
    Buckets whose members are all connected already are left out before the join,
    so a large group of copies yields no pairs here. Only the two values are shuffled, and once.
    """
    mixed = members.groupBy(*bucket).agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low < high").select(*bucket)
    left = members.join(mixed, bucket, "left_semi").select(*bucket, F.struct(
        *columns, "component").alias("a"))
    right = left.withColumnRenamed("a", "b")
    joined = left.join(right, [left[c] == right[c] for c in bucket] + [
        F.col("a.component") < F.col("b.component"), keep(F.col("a"), F.col("b"))])
    ends = [F.col(x)[columns[0]] for x in ("a", "b")]
    return joined.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct()
