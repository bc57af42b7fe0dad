"""What the trained operators share: folds, bounded samples, and training in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % 4


def held_out(doc_id: Column | str) -> Column:
    """Whether the id's fold is 2; a null id is in no fold and never learned from."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def train_once(sample: DataFrame, learn: Callable[[Iterator[pa.RecordBatch]], object]):
    """Run ``learn`` over a bounded sample in one executor task; its result comes back pickled.

    Training stays off the driver, so that a lost executor costs one retry and no memory there.
    """
    schema = T.StructType([T.StructField("model", T.BinaryType())])

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(batches))], pa.binary())], names=["model"])

    rows = sample.repartition(1).mapInArrow(run, schema).collect()
    return pickle.loads(rows[0]["model"]) if rows else None
