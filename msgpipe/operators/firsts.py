"""The first row of every key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """First row per key in the given total order.

    Spark keeps one row per key and task before the shuffle, so a key that makes
    up a large share of the rows does not pile up in one task.
    """
    window = W.partitionBy(key).orderBy(*order)
    return (df.withColumn("first_rank", F.row_number().over(window))
            .filter("first_rank = 1").drop("first_rank"))


def new_rows(batch: DataFrame, stored: DataFrame, key: str,
             order: Sequence[str | Column]) -> DataFrame:
    """Insert-or-ignore as a plan: first row per key, minus keys already stored.

    Of the stored table only the key column is read.
    """
    return first_per_key(batch, key, order).join(stored.select(key), key, "left_anti")
