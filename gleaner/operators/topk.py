"""Top-k with diversity, ranks with caps, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diversified(rows: DataFrame, order: list[Column], owner: str, single: Column, k: int, cap: int = 4) -> DataFrame:
    """The first ``k`` rows where a row that only one owner carries is deferred to
    the tail once that owner has ``cap`` rows before it.

    The running count needs no recursion: an owner's first ``cap`` rows are never
    deferred, so a row is deferred iff its rank within the owner is beyond them.
    """
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    marked = rows.withColumn("deferred", single & (rank > cap))
    chosen = marked.orderBy("deferred", *order).limit(k)
    place = F.row_number().over(Window.orderBy("deferred", *order))  # over k rows
    return chosen.withColumn("place", place)


def first_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", rank).where(F.col("place") <= k)
