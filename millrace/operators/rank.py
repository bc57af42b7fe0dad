"""Top-N and deduplication.

``row_number() <= n`` is what Catalyst plans as a group limit: each task keeps n rows of a partition key before
the shuffle, so a key with many rows ships few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, partition: list[str], order: list[Column], n: int, *, offset: int = 0, rank: str | None = None) -> DataFrame:
    """Ranks offset + 1 to offset + n in each partition.  The order must end in the arrival column: ties keep the earlier."""
    at = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    rows = df.withColumn("_rank", at).where(F.col("_rank") <= offset + n)
    rows = rows.where(F.col("_rank") > offset) if offset else rows
    return rows.drop("_rank") if rank is None else rows.withColumn(rank, F.col("_rank").cast("long")).drop("_rank")


def dedup_first(df: DataFrame, keys: list[str], ts: str, arrival: str) -> DataFrame:
    """The least row time; ties keep the row that came first."""
    return top_n(df, keys, [F.asc_nulls_last(ts), F.asc(arrival)], 1)


def dedup_last(df: DataFrame, keys: list[str], ts: str, arrival: str) -> DataFrame:
    """The greatest row time; ties go to the row that came last."""
    return top_n(df, keys, [F.desc_nulls_last(ts), F.desc(arrival)], 1)


def dedup_arrival(df: DataFrame, keys: list[str], arrival: str, *, first: bool = True) -> DataFrame:
    """Processing-time deduplication: by arrival alone."""
    return top_n(df, keys, [F.asc(arrival) if first else F.desc(arrival)], 1)


def window_top_n(windowed: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    return top_n(windowed, ["window_start", "window_end", *keys], order, n, rank=rank)
