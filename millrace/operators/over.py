"""OVER aggregates: one partition, one ascending time order, frames that end at the current row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.functions.scalar import epoch_ms


def range_unbounded(keys: list[str], ts: str) -> WindowSpec:
    """All rows up to the current one's time; rows of equal time share the value."""
    return Window.partitionBy(*keys).orderBy(F.asc(ts)).rangeBetween(Window.unboundedPreceding, Window.currentRow)


def rows_preceding(keys: list[str], ts: str, n: int, arrival: str | None = None) -> WindowSpec:
    order = [F.asc(ts)] + ([F.asc(arrival)] if arrival else [])
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, Window.currentRow)


def range_interval(keys: list[str], ts: str, ms: int, to_ms: Callable[[str], Column] = epoch_ms) -> WindowSpec:
    """Rows at most ``ms`` earlier, both ends inclusive; ``to_ms`` says in which millisecond a time is."""
    return Window.partitionBy(*keys).orderBy(to_ms(ts)).rangeBetween(-ms, Window.currentRow)


def over(df: DataFrame, spec: WindowSpec, aggregates: dict[str, Column]) -> DataFrame:
    """Appends the aggregates; all share one sort."""
    return df.select("*", *(c.over(spec).alias(n) for n, c in aggregates.items()))


def count_distinct(column: str, spec: WindowSpec) -> Column:
    return F.size(F.collect_set(column).over(spec)).cast("long")


def sum_distinct(column: str, spec: WindowSpec) -> Column:
    some = F.collect_set(F.col(column).cast("long")).over(spec)
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + x))


def ranks(keys: list[str], ts: str, arrival: str | None = None) -> dict[str, Column]:
    """row_number, rank and dense_rank as BIGINT columns over ascending time."""
    plain = Window.partitionBy(*keys).orderBy(F.asc(ts))
    ordered = Window.partitionBy(*keys).orderBy(*[F.asc(ts)] + ([F.asc(arrival)] if arrival else []))
    return {"row_number": F.row_number().over(ordered).cast("long"), "rank": F.rank().over(plain).cast("long"), "dense_rank": F.dense_rank().over(plain).cast("long")}
