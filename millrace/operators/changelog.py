"""Changelogs: folding them into tables, normalizing upserts, and aggregates that take removals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.rank import top_n
from millrace.types import DELETE, INSERT, PUTS, ROW_KIND, UPDATE_AFTER, UPDATE_BEFORE, weight


def tag(df: DataFrame, kind: Column | int = INSERT) -> DataFrame:
    return df.withColumn(ROW_KIND, (F.lit(kind) if isinstance(kind, int) else kind).cast("tinyint"))


def insert_only(df: DataFrame) -> DataFrame:
    """For operators that take no changelog: refuses one."""
    if ROW_KIND in df.columns:
        raise ValueError("this operator takes append-only input")
    return df


def collapse(df: DataFrame) -> DataFrame:
    """The table that a changelog has built: a multiset of rows, each as often as it was put more than removed."""
    columns = [c for c in df.columns if c != ROW_KIND]
    net = df.groupBy(*columns).agg(F.sum(weight()).alias("_net")).where(F.col("_net") > 0)
    return net.withColumn("_net", F.explode(F.array_repeat(F.lit(1), F.col("_net").cast("int")))).drop("_net")


def latest(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """An upsert stream's table: each key's last row, unless it is a removal."""
    return top_n(df, keys, [F.desc(arrival)], 1).where(F.col(ROW_KIND).isin(*PUTS)).drop(ROW_KIND)


def normalize(df: DataFrame, keys: list[str], arrival: str, *, update_before: bool = True) -> DataFrame:
    """An upsert stream as a regular changelog, in arrival order.

    A first put is +I; an unchanged one is left out; a changed one is -U (the stored row) and +U; a removal
    is -D of the stored row, and of an absent key nothing.
    """
    values = [c for c in df.columns if c not in (ROW_KIND, arrival)]
    order = Window.partitionBy(*keys).orderBy(arrival)
    put = F.col(ROW_KIND).isin(*PUTS)
    rows = df.withColumn("_row", F.struct(*values)).withColumn("_put", put)
    rows = rows.withColumn("_before", F.lag(F.when(F.col("_put"), F.col("_row"))).over(order))
    one = lambda kind, row, at: F.struct(F.lit(kind).cast("tinyint").alias(ROW_KIND), F.lit(at).alias("_order"), row.alias("_row"))
    changed = F.array(*([one(UPDATE_BEFORE, F.col("_before"), 0)] if update_before else []), one(UPDATE_AFTER, F.col("_row"), 1))
    nothing = F.filter(F.array(one(INSERT, F.col("_row"), 0)), lambda _: F.lit(False))
    moves = (
        F.when(F.col("_put") & F.col("_before").isNull(), F.array(one(INSERT, F.col("_row"), 0)))
        .when(F.col("_put") & ~F.col("_before").eqNullSafe(F.col("_row")), changed)
        .when(~F.col("_put") & F.col("_before").isNotNull(), F.array(one(DELETE, F.col("_before"), 0)))
        .otherwise(nothing)
    )
    return rows.select(arrival, F.explode(moves).alias("m")).select(F.col(f"m.{ROW_KIND}").alias(ROW_KIND), arrival, F.col("m._order").alias("change"), *(F.col(f"m._row.{c}").alias(c) for c in values))


def group_aggregate(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates given with ``weight()``; a key whose rows are all removed is gone."""
    rows = df.groupBy(*keys).agg(F.sum(weight()).alias("_rows"), *aggregates)
    return rows.where(F.col("_rows") > 0).drop("_rows")
