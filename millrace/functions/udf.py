"""User functions: scalar ones over Arrow batches, never row by row through pickled calls."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

#: Result types that a scalar function may have, and decimal(p,s).
RESULTS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "float": pa.float32(), "smallint": pa.int16(), "tinyint": pa.int8()}


def scalar(f: Callable, result: str, deterministic: bool = True) -> Callable[..., Column]:
    """A function of one row's values as a column function; NULLs are passed on to it as None."""
    exact = re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", result)
    if result not in RESULTS and not exact:
        raise ValueError(f"a scalar function returns one of {', '.join(RESULTS)} or decimal(p,s)")
    kind = pa.decimal128(int(exact[1]), int(exact[2])) if exact else RESULTS[result]

    def run(*columns: pa.Array) -> pa.Array:
        values = [f(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)]
        return pa.array(values, kind)

    made = F.arrow_udf(run, result, ArrowUDFType.SCALAR)
    return made if deterministic else made.asNondeterministic()
