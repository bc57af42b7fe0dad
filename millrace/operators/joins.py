"""Regular, interval, window, temporal and lookup joins of bounded inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import epoch_ms
from millrace.types import DELETE, ROW_KIND, UPDATE_BEFORE

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def regular(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Left's columns, then right's (left's alone for semi and anti).  NULL keys match nothing; a residual is part of ``on``."""
    return left.join(right, on, KINDS[how])


def interval(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], times: tuple[str, str], lower: int, upper: int, how: str = "inner", residual: Column | None = None) -> DataFrame:
    """lower <= left time - right time <= upper (milliseconds), equal keys, and the residual.

    Times are also joined by bucket: a bucket is as wide as the interval, so each left row has one and each
    right row at most two, and a task compares rows of neighbouring times only, however common a key is.
    Column names of the two sides must differ.
    """
    if how == "right":
        columns = [*left.columns, *right.columns]
        flipped = [(b, a) for a, b in keys]
        return interval(right, left, flipped, (times[1], times[0]), -upper, -lower, "left", residual).select(*columns)
    if how == "full":
        matched = interval(left, right, keys, times, lower, upper, "left", residual)
        alone = interval(left, right, keys, times, lower, upper, "right", residual).where(F.col(times[0]).isNull())
        return matched.unionByName(alone)
    width = max(upper - lower, 1)
    a = left.withColumn("_ms", epoch_ms(times[0])).withColumn("_bucket", F.floor(F.col("_ms") / width))
    b = right.withColumn("_other", epoch_ms(times[1]))
    b = b.withColumn("_buckets", F.sequence(F.floor((F.col("_other") + lower) / width), F.floor((F.col("_other") + upper) / width)))
    b = b.withColumn("_at", F.explode("_buckets")).drop("_buckets")
    on = (F.col("_bucket") == F.col("_at")) & (F.col("_ms") - F.col("_other")).between(lower, upper)
    for x, y in keys:
        on = on & (left[x] == right[y])
    if residual is not None:
        on = on & residual
    return a.join(b, on, KINDS[how]).drop("_ms", "_bucket", "_other", "_at")


def window(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Equal keys and equal windows.  Both sides have window_start and window_end; the right's come out as r_window_start and r_window_end."""
    right = right.withColumnsRenamed({"window_start": "r_window_start", "window_end": "r_window_end"}).drop("window_time")
    on = (F.col("window_start") == F.col("r_window_start")) & (F.col("window_end") == F.col("r_window_end"))
    for x, y in keys:
        on = on & (F.col(x) == F.col(y))
    if residual is not None:
        on = on & residual
    return left.join(right, on, KINDS[how])


def temporal(probe: DataFrame, versions: DataFrame, key: tuple[str, str], times: tuple[str, str], arrival: str, how: str = "inner", residual: Column | None = None, segment_ms: int | None = None) -> DataFrame:
    """Each probe with the latest version of its key at or before its time.

    One pass: probes and versions are merged, sorted by key and time, and the last version is carried on,
    so nothing is paired that does not match.  Of versions at one time the last to arrive counts.  A latest version that is a
    removal (``_row_kind`` -D or -U) means that there is no row, not an older one.  A failing residual pads or drops.
    Column names of the two sides must differ (but for ``_row_kind``).

    segment_ms: deals each key by stretches of time too, so that a very common key is sorted by many tasks;
    a stretch starts with the last version before it, found among one row per key and stretch.
    """
    kind = F.col(ROW_KIND).isin(DELETE, UPDATE_BEFORE) if ROW_KIND in versions.columns else F.lit(False)
    kept = [c for c in versions.columns if c != ROW_KIND]
    v = versions.where(F.col(times[1]).isNotNull() & F.col(key[1]).isNotNull()).select(
        F.col(key[1]).alias("_key"), epoch_ms(times[1]).alias("_ms"), F.lit(0).alias("_side"), F.col(arrival).cast("long").alias("_seq"), F.struct(kind.alias("gone"), *kept).alias("_version")
    )
    p = probe.select(F.col(key[0]).alias("_key"), epoch_ms(times[0]).alias("_ms"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_seq"), F.struct(*probe.columns).alias("_probe"))
    both = v.unionByName(p, allowMissingColumns=True)
    both = both.withColumn("_segment", F.floor(F.col("_ms") / segment_ms) if segment_ms else F.lit(0))
    upto = Window.partitionBy("_key", "_segment").orderBy("_ms", "_side", "_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_last", F.last("_version", ignorenulls=True).over(upto)).where(F.col("_side") == 1)
    if segment_ms:
        last = both.groupBy("_key", "_segment").agg(F.max_by("_version", F.when(F.col("_side") == 0, F.struct("_ms", "_seq"))).alias("_version"))
        before = Window.partitionBy("_key").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
        start = last.select(F.col("_key").alias("_k"), F.col("_segment").alias("_s"), F.last("_version", ignorenulls=True).over(before).alias("_start"))
        carried = carried.join(start, (F.col("_key") == F.col("_k")) & (F.col("_segment") == F.col("_s")), "left").withColumn("_last", F.coalesce("_last", "_start"))
    out = carried.select("_probe.*", F.when(F.col("_key").isNotNull() & ~F.col("_last.gone"), F.col("_last")).alias("_last"))
    out = out.select(*probe.columns, F.col("_last").isNotNull().alias("_hit"), *(F.col(f"_last.{c}").alias(c) for c in kept))
    if residual is not None:
        out = out.withColumn("_hit", F.col("_hit") & F.coalesce(residual, F.lit(False)))
    if how == "inner":
        return out.where("_hit").drop("_hit")
    return out.select(*probe.columns, *(F.when(F.col("_hit"), F.col(c)).alias(c) for c in kept))


def lookup(probe: DataFrame, dimension: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """A dimension table read when the query runs; a filter or projection of it is applied before.

    No broadcast is forced: the planner broadcasts a dimension whose size it knows to be small.
    """
    return probe.join(dimension, on, KINDS[how])
