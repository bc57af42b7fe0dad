"""The data model: row kinds of changelogs, and SQL types without a Spark type of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column that carries a row's kind; a table without it is append-only.
ROW_KIND = "_row_kind"
#: Kinds of changes.
INSERT, UPDATE_BEFORE, UPDATE_AFTER, DELETE = 0, 1, 2, 3
KIND_NAMES = {INSERT: "+I", UPDATE_BEFORE: "-U", UPDATE_AFTER: "+U", DELETE: "-D"}
PUTS = (INSERT, UPDATE_AFTER)

#: Integer types: bits, and least and greatest values.
INTEGERS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def weight(kind: Column | str = ROW_KIND) -> Column:
    """1 for rows put, -1 for rows removed."""
    column = F.col(kind) if isinstance(kind, str) else kind
    return F.when(column.isin(*PUTS), F.lit(1)).otherwise(F.lit(-1)).cast("long")


def limits(name: str) -> tuple[int, int]:
    bits = INTEGERS[name]
    return -(1 << (bits - 1)), (1 << (bits - 1)) - 1


def multiset(element: T.DataType) -> T.MapType:
    """A multiset is a map from element to count."""
    return T.MapType(element, T.IntegerType(), False)


def spark_type(sql: str) -> T.DataType:
    """A declared SQL type as a Spark type.

    CHAR and VARCHAR are strings (casts pad and truncate), BINARY(n) is binary, TIME is milliseconds of
    the day in a BIGINT, TIMESTAMP is without zone, TIMESTAMP_LTZ with the session's zone, MULTISET a map.
    """
    text = " ".join(sql.strip().split())
    upper = text.upper()
    head = upper.split("(")[0].split("<")[0].strip()
    if head in ("CHAR", "VARCHAR", "STRING"):
        return T.StringType()
    if head in ("BINARY", "VARBINARY", "BYTES"):
        return T.BinaryType()
    if head == "TIME":
        return T.LongType()
    if head == "TIMESTAMP_LTZ":
        return T.TimestampType()
    if head == "TIMESTAMP":
        return T.TimestampNTZType()
    if head in ("ARRAY", "MULTISET", "MAP", "ROW"):
        inner = _split(text[text.index("<") + 1 : text.rindex(">")])
        if head == "ARRAY":
            return T.ArrayType(spark_type(inner[0]))
        if head == "MULTISET":
            return multiset(spark_type(inner[0]))
        if head == "MAP":
            return T.MapType(spark_type(inner[0]), spark_type(inner[1]))
        return T.StructType([T.StructField(f.split(" ", 1)[0], spark_type(f.split(" ", 1)[1])) for f in inner])
    plain = {"TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "BOOLEAN": T.BooleanType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "DATE": T.DateType()}
    if head in plain:
        return plain[head]
    if head in ("DECIMAL", "NUMERIC"):
        p, s = (upper[upper.index("(") + 1 : -1].split(",") + ["0"])[:2] if "(" in upper else ("10", "0")
        return T.DecimalType(int(p), int(s))
    if head.startswith("INTERVAL"):
        return T.YearMonthIntervalType() if "YEAR" in head or "MONTH" in head else T.DayTimeIntervalType()
    raise ValueError(f"unsupported type {sql}")


def _split(text: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(text[at:i].strip())
            at = i + 1
    return [*parts, text[at:].strip()]


def schema(columns: dict[str, str]) -> T.StructType:
    """A declared table's schema; always fixed, never inferred."""
    return T.StructType([T.StructField(n, spark_type(t)) for n, t in columns.items()])
