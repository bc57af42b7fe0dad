"""Windows over event time: TUMBLE, HOP (gapped too), CUMULATE, SESSION, and aggregates over them.

Sizes are milliseconds.  The TVFs append window_start, window_end and window_time (end - 1 ms) and drop
rows without a time; HOP and CUMULATE repeat a row for each of its windows.  The same functions take bounded
and streaming inputs (a stream's time is a TIMESTAMP with a watermark).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import epoch_ms


def _span(ms: int) -> str:
    return f"{ms} milliseconds"


def _plus(ts: Column, ms: int) -> Column:
    return ts + F.expr(f"INTERVAL '{ms // 1000}.{ms % 1000:03d}' SECOND") if ms >= 0 else ts - F.expr(f"INTERVAL '{-ms // 1000}.{-ms % 1000:03d}' SECOND")


def _flat(df: DataFrame, columns: list[str], size: int | None = None) -> DataFrame:
    end = F.col("window.end") if size is None else _plus(F.col("window.start"), size)
    return df.select(*columns, F.col("window.start").alias("window_start"), end.alias("window_end"), _plus(end, -1).alias("window_time"))


def tumble(df: DataFrame, ts: str, size: int) -> DataFrame:
    rows = df.where(F.col(ts).isNotNull())
    return _flat(rows.withColumn("window", F.window(ts, _span(size))), df.columns)


def hop(df: DataFrame, ts: str, slide: int, size: int) -> DataFrame:
    """A slide beyond the size leaves gaps, whose rows belong to no window."""
    rows = df.where(F.col(ts).isNotNull())
    if slide > size:
        rows = rows.where(F.pmod(epoch_ms(ts), F.lit(slide)) < size)
        return _flat(rows.withColumn("window", F.window(ts, _span(slide))), df.columns, size)
    return _flat(rows.withColumn("window", F.window(ts, _span(size), _span(slide))), df.columns)


def _steps(ts: str, step: int, size: int) -> Column:
    first = F.floor(F.pmod(epoch_ms(ts), F.lit(size)) / step).cast("int") + 1
    return F.sequence(first, F.lit(size // step))


def cumulate(df: DataFrame, ts: str, step: int, size: int) -> DataFrame:
    """Windows that begin every ``size`` and end at each ``step`` within."""
    if size % step:
        raise ValueError("the step must divide the size")
    rows = df.where(F.col(ts).isNotNull()).select("*", F.explode(_steps(ts, step, size)).alias("_step")).withColumn("window", F.window(ts, _span(size)))
    end = F.col("window.start") + F.make_dt_interval(secs=(F.col("_step").cast("long") * step / 1000).cast("decimal(18,6)"))
    return rows.select(*df.columns, F.col("window.start").alias("window_start"), end.alias("window_end"), _plus(end, -1).alias("window_time"))


def aggregate(windowed: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """One row per window and key; without aggregates the distinct ones."""
    columns = ["window_start", "window_end", *keys]
    return windowed.groupBy(*columns).agg(*aggregates) if aggregates else windowed.select(*columns).distinct()


def tumble_aggregate(df: DataFrame, ts: str, size: int, keys: list[str], *aggregates: Column) -> DataFrame:
    rows = df.where(F.col(ts).isNotNull()).groupBy(F.window(ts, _span(size)).alias("window"), *keys).agg(*aggregates)
    return rows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in rows.columns if c != "window"])


def hop_aggregate_rows(df: DataFrame, ts: str, slide: int, size: int, keys: list[str], *aggregates: Column) -> DataFrame:
    """HOP over rows, for streams: the watermark stays with the window, so windows close one by one."""
    rows = df.where(F.col(ts).isNotNull())
    if slide > size:
        rows = rows.where(F.pmod(epoch_ms(ts), F.lit(slide)) < size)
    out = rows.groupBy(F.window(ts, _span(max(size, slide)), _span(slide)).alias("window"), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), _plus(F.col("window.start"), size).alias("window_end"), *[c for c in out.columns if c != "window"])


def hop_aggregate(df: DataFrame, ts: str, slide: int, size: int, keys: list[str], partial: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """HOP by shared slices: rows are aggregated once per slice, and only slices are repeated for windows.

    partial: aggregates over a slice's rows; final: aggregates over those columns.  Slices are gcd(size, slide)
    wide, so a row is never copied size / slide times before it is summed.
    """
    width = math.gcd(size, slide)
    slices = tumble_aggregate(df, ts, width, keys, *(c.alias(n) for n, c in partial.items()))
    slices = slices.select(F.col("window_start").alias("_slice"), *keys, *partial)
    return aggregate(hop(slices, "_slice", slide, size), keys, *(c.alias(n) for n, c in final.items()))


def cumulate_aggregate(df: DataFrame, ts: str, step: int, size: int, keys: list[str], partial: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """CUMULATE by shared slices of one step."""
    slices = tumble_aggregate(df, ts, step, keys, *(c.alias(n) for n, c in partial.items()))
    slices = slices.select(F.col("window_start").alias("_slice"), *keys, *partial)
    return aggregate(cumulate(slices, "_slice", step, size), keys, *(c.alias(n) for n, c in final.items()))


def session_aggregate(df: DataFrame, ts: str, gap: int, keys: list[str], *aggregates: Column) -> DataFrame:
    """Sessions end ``gap`` after their last row; a row exactly ``gap`` later still joins."""
    rows = df.where(F.col(ts).isNotNull()).groupBy(F.session_window(ts, _span(gap)).alias("window"), *keys).agg(*aggregates)
    return rows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in rows.columns if c != "window"])


def legacy(windowed: DataFrame) -> DataFrame:
    """Names of the older GROUP BY TUMBLE/HOP/SESSION form: w_start, w_end, w_rowtime = end - 1 ms."""
    rest = [c for c in windowed.columns if c not in ("window_start", "window_end")]
    return windowed.select(F.col("window_start").alias("w_start"), F.col("window_end").alias("w_end"), _plus(F.col("window_end"), -1).alias("w_rowtime"), *rest)
