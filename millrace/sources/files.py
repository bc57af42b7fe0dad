"""File sources and sinks, a generator, and an upserting Parquet snapshot."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.types import DELETE, ROW_KIND, UPDATE_BEFORE

CODECS = ("snappy", "gzip", "zstd", "none")


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, *, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def write_parquet(df: DataFrame, path: str, *, partition_by: list[str] = (), codec: str = "snappy", mode: str = "append", rows_per_file: int | None = None) -> None:
    """Append-only Parquet; a ``_row_kind`` column is written like any other."""
    if codec not in CODECS:
        raise ValueError(f"codec is one of {CODECS}")
    writer = df.write.mode(mode).option("compression", codec)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def sink_parquet(df: DataFrame, path: str, checkpoint: str, *, partition_by: list[str] = (), codec: str = "snappy"):
    """A streaming Parquet sink that takes what there is and ends; exactly once by its checkpoint."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("compression", codec).outputMode("append").trigger(availableNow=True)
    return (writer.partitionBy(*partition_by) if partition_by else writer).start()


def blackhole(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def datagen(spark: SparkSession, n: int, columns: dict[str, Column]) -> DataFrame:
    """n rows; columns are expressions over ``i`` from 0."""
    return spark.range(n).withColumnRenamed("id", "i").select(*(c.alias(k) for k, c in columns.items()))


class Snapshot:
    """A table kept as Parquet, with appends and keyed upserts; readers see one version at a time.

    Rows are dealt to ``buckets`` by key.  An upsert rewrites only the buckets that a batch touches, as new
    folders, and then puts a new manifest (bucket to folder) in place with one rename; an interrupted upsert
    leaves the last version as it was.  Only the manifest, one line per bucket, is on the driver.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType, buckets: int = 16):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path, keys, schema, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        where = self._path(f"{self.path}/_manifests")
        if not self._fs.exists(where):
            return []
        return sorted(int(m[1]) for f in self._fs.listStatus(where) if (m := re.fullmatch(r"(\d+)", f.getPath().getName())))

    def _manifest(self, version: int | None = None) -> tuple[int, dict[int, str]]:
        versions = self._versions()
        if not versions:
            return 0, {}
        version = versions[-1] if version is None else version
        rows = self.spark.read.schema("bucket int, folder string").json(f"{self.path}/_manifests/{version}").collect()  # one row per bucket
        return version, {r["bucket"]: r["folder"] for r in rows}

    def read(self, version: int | None = None) -> DataFrame:
        _, folders = self._manifest(version)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in sorted(folders.values())))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def upsert(self, changes: DataFrame, arrival: str) -> int:
        """Applies a changelog batch; the last change of a key wins.  Returns the new version."""
        from millrace.operators.rank import top_n

        version, folders = self._manifest()
        last = top_n(changes.where(F.col(ROW_KIND) != UPDATE_BEFORE), self.keys, [F.desc(arrival)], 1).withColumn("_bucket", self._bucket())
        touched = [r["_bucket"] for r in last.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return version
        old = [f"{self.path}/{folders[b]}" for b in touched if b in folders]
        before = self.spark.read.schema(self.schema).parquet(*old) if old else self.spark.createDataFrame([], self.schema)
        kept = before.join(last.select(*self.keys), self.keys, "left_anti").withColumn("_bucket", self._bucket())
        after = kept.select(*self.schema.names, "_bucket").unionByName(last.where(F.col(ROW_KIND) != DELETE).select(*self.schema.names, "_bucket"))
        run = uuid.uuid4().hex
        after.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{run}")
        written = {b: f"{run}/_bucket={b}" for b in touched if self._fs.exists(self._path(f"{self.path}/{run}/_bucket={b}"))}
        now = {b: f for b, f in folders.items() if b not in touched} | written
        draft = f"{self.path}/_manifests/_draft-{run}"
        self.spark.createDataFrame([(b, f) for b, f in sorted(now.items())], "bucket int, folder string").coalesce(1).write.json(draft)
        if not self._fs.rename(self._path(draft), self._path(f"{self.path}/_manifests/{version + 1}")):
            raise RuntimeError("another writer has put this version in place")
        return version + 1
