"""Consecutive numbers over a whole table, without one task for all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Sampled keys the range bounds are taken from; also the most ranges possible.
_SAMPLE_KEYS = 4000


def range_bounds(df: DataFrame, keys: Sequence[str], ranges: int) -> list[tuple]:
    """Up to ``ranges - 1`` key tuples that cut the table into similar parts.

    Taken from a fixed-size sample, the rows with the smallest key hashes, so the
    driver sees a bounded number of values. The bounds only balance the work: any
    bounds give the same numbers.
    """
    sample = (df.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(_SAMPLE_KEYS)
              .orderBy(*keys).collect())
    step = max(1, -(-len(sample) // ranges))
    return [tuple(row) for row in sample[step::step]]


def _range_number(keys: Sequence[str], schema: StructType, bounds: list[tuple]) -> Column:
    """Number of bounds at or below a row's key, by halving."""
    key = F.struct(*keys)
    cuts = [F.struct(*(F.lit(v).cast(schema[k].dataType).alias(k) for k, v in zip(keys, bound)))
            for bound in bounds]

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < cuts[middle], search(low, middle)).otherwise(
            search(middle + 1, high))

    return search(0, len(cuts))


def global_row_number(df: DataFrame, keys: Sequence[str], alias: str = "row_number",
                      ranges: int | None = None) -> DataFrame:
    """1, 2, 3, ... in the order of ``keys``, which must identify a row.

    Rows are numbered within key ranges; what earlier ranges hold is one count per
    range, a table of at most ``ranges`` rows that is broadcast. The bounds are
    literals in the plan, so a recomputed task sees the same ranges.
    """
    if ranges is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(ranges, _SAMPLE_KEYS))
    part = _range_number(keys, df.schema, range_bounds(df, keys, ranges))
    parted = df.withColumn("key_range", part)
    counts = parted.groupBy("key_range").agg(F.count(F.lit(1)).alias("rows"))
    before = W.orderBy("key_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "key_range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    within = W.partitionBy("key_range").orderBy(*keys)
    numbered = parted.withColumn(alias, F.row_number().over(within).cast("bigint"))
    return (numbered.join(F.broadcast(offsets), "key_range")
            .withColumn(alias, F.col(alias) + F.col("rows_before"))
            .drop("key_range", "rows_before"))


def sample_names(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``sample_name``: 001_sample.json, 002_sample.json, ... in key order."""
    numbered = global_row_number(df, keys, "sample_number")
    return numbered.withColumn(
        "sample_name", F.format_string("%03d_sample.json", "sample_number")).drop("sample_number")
