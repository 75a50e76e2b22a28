"""Checks that a query plan keeps, whatever columns are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def refuse(rows: DataFrame, problem: Column) -> DataFrame:
    """The rows, failing the job on the first one with a problem.

    A filter: unlike an error hung on a column, no projection or count leaves it out.
    """
    return rows.filter(F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean"))
                       .otherwise(F.lit(True)))
