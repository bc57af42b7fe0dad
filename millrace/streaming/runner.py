"""Running streams to the end of their input, with exactly-once output by epoch."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import ROCKSDB, scratch
from millrace.streaming.processors import Values

#: A time past all others: the row that carries it lets every window close at the end of a bounded input.
END = "2100-01-01 00:00:00"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package, and keeps state in RocksDB."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    if spark.conf.get(_PROVIDER, "") != ROCKSDB:
        spark.conf.set(_PROVIDER, ROCKSDB)


def events_stream(spark: SparkSession, sf_dir: str, *, end: bool = True, delay: str = "0 seconds") -> DataFrame:
    """The events with a TIMESTAMP ``ts`` and its watermark; with ``end``, a last row (event_id NULL) closes all windows."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    if end:
        path = scratch(spark, "end")
        last = spark.range(1).select(*(F.lit(END).cast(f.dataType).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        last.write.parquet(path)
        rows = rows.unionByName(spark.readStream.schema(schema).parquet(path))
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def finish(df: DataFrame, mode: str = "append", tag: str = "stream", order: list[Column] | None = None) -> DataFrame:
    """Runs a stream until its input is used up and returns all that it gave.

    Each epoch overwrites a folder of its own, so an epoch that is run again after a failure does not
    count twice.  With ``order``, an epoch's rows are written in that order, and the epochs are returned one after the other.
    """
    spark = df.sparkSession
    ready(spark)
    path = scratch(spark, tag)

    def put(batch: DataFrame, epoch: int) -> None:
        out = f"{path}/out/_epoch={epoch}"
        if not order:
            return batch.write.mode("overwrite").parquet(out)
        held = batch.persist()  # a sort reads its input twice, and the state is to be read once
        try:
            held.orderBy(*order).write.mode("overwrite").parquet(out)
        finally:
            held.unpersist()

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(df.schema).option("basePath", f"{path}/out").parquet(f"{path}/out/*")
    return (out.orderBy("_epoch", *order) if order else out).drop("_epoch")


def held_back(df: DataFrame, time: str, arrival: str) -> DataFrame:
    """Rows wait until the watermark has passed their time; rows without a time do not wait.

    Rows that share their time and ``arrival`` share a state entry, so with arrivals that differ the work is spread however the times are.
    """
    groups = df.groupBy(F.window(time, "1 millisecond"), arrival).agg(F.collect_list(F.struct(*df.columns)).alias("_rows"))
    return groups.select(F.inline("_rows")).unionByName(df.where(F.col(time).isNull()))


def time_sort(df: DataFrame, time: str, arrival: str) -> DataFrame:
    """Runs a stream to its end and returns its rows by time, ties in arrival order; rows without a time come last in their epoch."""
    return finish(held_back(df, time, arrival), order=[F.asc_nulls_last(time), F.asc_nulls_last(arrival)])


def keyed(df: DataFrame, keys: list[str], processor, schema: T.StructType, *, mode: str = "Update", time: str = "None") -> DataFrame:
    """A custom stateful operator over keys.

    Workers would see integers beside NULLs as floats, so every value goes there as text and is read by its declared
    type (``processors.Values``).  Workers do not see columns whose names begin with an underscore, so
    those come without it (``row_kind``).
    """
    ready(df.sparkSession)
    df = df.withColumnsRenamed({c: c.lstrip("_") for c in df.columns if c.startswith("_")})
    processor.values = Values({f.name: f.dataType.simpleString() for f in df.schema}, keys)
    # event-time columns with a watermark stay beside their text
    marked = [f.name for f in df.schema if time == "EventTime" and isinstance(f.dataType, T.TimestampType)]
    text = [(F.base64(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name).cast("string")).alias(f.name) for f in df.schema if f.name not in marked]
    return df.select(*text, *marked).groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode=time)


def ntz(df: DataFrame) -> DataFrame:
    """TIMESTAMP columns without zone, as bounded queries give them."""
    return df.select(*(F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema))


Builder = Callable[[SparkSession, str], DataFrame]
