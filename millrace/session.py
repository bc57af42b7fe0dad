"""Sessions, table loading, and the folder for shared intermediate files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(name: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session as the operators expect it: UTC, adaptive execution, RocksDB state.

    Operators do not depend on ``spark.sql.ansi.enabled``: wrapping, saturating and failing are explicit.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, in a temporary folder on a local master, else ValueError."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where}/millrace-{tag}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def explain(df: DataFrame) -> str:
    """The formatted physical plan, and which of its parts are Python or single-partition."""
    plan = df._jdf.queryExecution().toString()
    notes = [what for what, mark in (("runs Python", "Python"), ("runs Python on Arrow batches", "InArrow"), ("gathers into one partition", "SinglePartition"), ("is a nested-loop join", "NestedLoop"), ("is a Cartesian product", "CartesianProduct")) if mark in plan]
    return plan + "\n== Notes ==\n" + ("\n".join(f"- {n}" for n in notes) or "- native operators only")
