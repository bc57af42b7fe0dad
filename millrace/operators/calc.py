"""Projection, filter, union, limit, sort, grouping sets and unnest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calc(df: DataFrame, columns: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Filter, then project; rows whose predicate is false or NULL are dropped.  A ``_row_kind`` stays if projected."""
    rows = df if where is None else df.where(where)
    return rows.select(*(c.alias(n) for n, c in columns.items()))


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first


def union_distinct(first: DataFrame, *others: DataFrame) -> DataFrame:
    return union_all(first, *others).distinct()


def limit(df: DataFrame, order: list[Column], n: int, offset: int = 0) -> DataFrame:
    """The rows at offset + 1 to offset + n in the order; plain LIMIT passes the arrival column."""
    rows = df.orderBy(*order)
    return (rows.offset(offset) if offset else rows).limit(n)


def event_time_sort(df: DataFrame, rowtime: str, arrival: str) -> DataFrame:
    """Ascending by row time, ties in arrival order; rows without a row time are dropped."""
    return df.where(F.col(rowtime).isNotNull()).orderBy(F.asc(rowtime), F.asc(arrival))


def grouping_sets(df: DataFrame, sets: list[list[str]], columns: list[str], *aggregates: Column) -> DataFrame:
    """One row per group of each set; columns grouped out are NULL.  Adds ``grouping_id`` as BIGINT."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id().cast("long").alias("grouping_id"), *aggregates)


def rollup(df: DataFrame, columns: list[str], *aggregates: Column) -> DataFrame:
    return df.rollup(*columns).agg(F.grouping_id().cast("long").alias("grouping_id"), *aggregates)


def cube(df: DataFrame, columns: list[str], *aggregates: Column) -> DataFrame:
    return df.cube(*columns).agg(F.grouping_id().cast("long").alias("grouping_id"), *aggregates)


def unnest_array(df: DataFrame, column: str, name: str, *, left: bool = False, ordinality: str | None = None) -> DataFrame:
    """Scalar elements, NULL ones included; LEFT keeps rows of NULL and empty arrays once."""
    if ordinality is None:
        return df.select("*", (F.explode_outer if left else F.explode)(column).alias(name))
    at = F.posexplode_outer(column) if left else F.posexplode(column)
    return df.select("*", at.alias("_at", name)).withColumn(ordinality, (F.col("_at") + 1).cast("int")).drop("_at")


def unnest_rows(df: DataFrame, column: str, *, left: bool = False, ordinality: str | None = None) -> DataFrame:
    """ARRAY<ROW>: NULL rows are dropped, and an array of them only pads like an empty one."""
    fields = df.schema[column].dataType.elementType.names
    rows = F.filter(column, lambda x: x.isNotNull())
    at = F.posexplode_outer(rows) if left else F.posexplode(rows)
    out = df.select("*", at.alias("_at", "_row"))
    extra = [] if ordinality is None else [(F.col("_at") + 1).cast("int").alias(ordinality)]
    return out.select(*df.columns, *(F.col(f"_row.{f}").alias(f) for f in fields), *extra)


def unnest_map(df: DataFrame, column: str, key: str, value: str, *, left: bool = False) -> DataFrame:
    return df.select("*", (F.explode_outer if left else F.explode)(column).alias(key, value))


def unnest_multiset(df: DataFrame, column: str, name: str, *, left: bool = False, ordinality: str | None = None) -> DataFrame:
    """Each element as often as it counts."""
    flat = F.flatten(F.transform(F.map_entries(column), lambda e: F.array_repeat(e["key"], e["value"])))
    return unnest_array(df.withColumn("_flat", flat), "_flat", name, left=left, ordinality=ordinality).drop("_flat")
