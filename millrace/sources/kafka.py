"""Kafka transport, for sessions that have the connector; codecs are apart from it (``formats``, ``binary``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def available(spark: SparkSession) -> bool:
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:
        return False


def _need(spark: SparkSession) -> None:
    if not available(spark):
        raise RuntimeError("this session has no Kafka connector; add it to spark.jars.packages")


def read(spark: SparkSession, servers: str, topics: str, *, starting: str = "earliest", bounded: bool = False, **options: str) -> DataFrame:
    """key, value, topic, partition, offset, timestamp; ``bounded`` reads up to the offsets of now."""
    _need(spark)
    reader = spark.read if bounded else spark.readStream
    options = {"kafka.bootstrap.servers": servers, "subscribe": topics, "startingOffsets": starting} | ({"endingOffsets": "latest"} if bounded else {}) | options
    return reader.format("kafka").options(**options).load()


def write(df: DataFrame, servers: str, topic: str, checkpoint: str, **options: str):
    """A stream of ``value`` and perhaps ``key`` (a NULL value is a tombstone)."""
    _need(df.sparkSession)
    columns = [F.col(c).cast("binary").alias(c) for c in ("key", "value") if c in df.columns]
    return df.select(*columns).writeStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint} | options).start()
