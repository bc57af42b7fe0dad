"""Payload codecs over a column: JSON, CSV, raw, and change-data-capture envelopes.

Decoders take a string or binary column and a fixed schema.  ``lenient`` turns fields that can't be parsed
into NULL; otherwise a bad payload fails the query.  CDC decoders return the table's columns and ``_row_kind``.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalar import wrap
from millrace.types import DELETE, INSERT, ROW_KIND, UPDATE_AFTER, UPDATE_BEFORE


def _mode(lenient: bool) -> dict[str, str]:
    return {"mode": "PERMISSIVE" if lenient else "FAILFAST"}


def _text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


# -- JSON ------------------------------------------------------------------------------------------------


def json_decode(value: Column | str, schema: T.StructType, *, lenient: bool = False, **options: str) -> Column:
    return F.from_json(_text(value), schema, _mode(lenient) | options)


def json_rows(df: DataFrame, value: str, schema: T.StructType, *, lenient: bool = False) -> DataFrame:
    """One row per object; a top-level array gives one per element."""
    array = F.from_json(_text(value), T.ArrayType(schema), _mode(lenient))
    return df.select(*[c for c in df.columns if c != value], F.inline(array))


def json_encode(columns: list[str] | Column, *, ignore_null_fields: bool = False) -> Column:
    row = columns if isinstance(columns, Column) else F.struct(*columns)
    return F.to_json(row, {"ignoreNullFields": str(ignore_null_fields).lower()})


# -- CSV -------------------------------------------------------------------------------------------------


def _csv_options(delimiter: str, quote: str | None, null_literal: str | None, comments: bool) -> dict[str, str]:
    out = {"sep": delimiter, "quote": quote if quote is not None else "\u0000"}
    if null_literal is not None:
        out["nullValue"] = null_literal
    if comments:
        out["comment"] = "#"
    return out


def csv_decode(value: Column | str, schema: T.StructType, *, delimiter: str = ",", quote: str | None = '"', null_literal: str | None = None, comments: bool = False, lenient: bool = False) -> Column:
    return F.from_csv(_text(value), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), _mode(lenient) | _csv_options(delimiter, quote, null_literal, comments))


def csv_encode(columns: list[str], *, delimiter: str = ",", quote: str | None = '"', null_literal: str | None = None) -> Column:
    return F.to_csv(F.struct(*columns), _csv_options(delimiter, quote, null_literal, False))


# -- raw -------------------------------------------------------------------------------------------------

_INTEGERS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}


def _swapped(hexed: Column, size: int) -> Column:
    return F.concat(*(F.substring(hexed, 2 * i + 1, 2) for i in reversed(range(size))))


def raw_decode(value: Column | str, to: str, *, little_endian: bool = False) -> Column:
    """One column as bytes: string, binary, boolean, integers and floats of fixed width; another length fails."""
    value = F.col(value) if isinstance(value, str) else value
    if to in ("string", "binary"):
        return value.cast(to)
    if to == "boolean":
        return F.hex(_exact(value, 1)) != "00"
    if to in _INTEGERS:
        hexed = F.hex(_exact(value, _INTEGERS[to]))
        hexed = _swapped(hexed, _INTEGERS[to]) if little_endian else hexed
        return wrap(F.conv(hexed, 16, 10).cast("decimal(20,0)"), "bigint").cast("bigint") if to == "bigint" else wrap(F.conv(hexed, 16, 10).cast("bigint"), to)
    form, size = ("<" if little_endian else ">") + {"float": "f", "double": "d"}[to], {"float": 4, "double": 8}[to]

    @F.pandas_udf(to)
    def unpack(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else struct.unpack(form, bytes(b))[0])

    return unpack(_exact(value, size))


def _exact(value: Column, size: int) -> Column:
    wrong = F.raise_error(F.concat(F.lit(f"expected {size} bytes, got "), F.octet_length(value).cast("string"))).cast("binary")
    return F.when(F.octet_length(value) != size, wrong).otherwise(value)


def raw_encode(value: Column | str, kind: str, *, little_endian: bool = False) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    if kind in ("string", "binary"):
        return value.cast("binary")
    if kind == "boolean":
        return F.when(value, F.unhex(F.lit("01"))).otherwise(F.when(~value, F.unhex(F.lit("00"))))
    if kind in _INTEGERS:
        size = _INTEGERS[kind]
        hexed = F.substring(F.lpad(F.hex(value.cast("bigint")), 16, "0"), 17 - 2 * size, 2 * size)
        return F.unhex(_swapped(hexed, size) if little_endian else hexed)
    form = ("<" if little_endian else ">") + {"float": "f", "double": "d"}[kind]

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if pd.isna(x) else struct.pack(form, x))

    return packed(value)


# -- change data capture -----------------------------------------------------------------------------------


def _changes(df: DataFrame, value: str, schema: T.StructType, images: Column) -> DataFrame:
    """images: array of (kind, row)."""
    keep = [c for c in df.columns if c != value]
    return df.select(*keep, F.explode(images).alias("_c")).select(*keep, F.col("_c.kind").cast("tinyint").alias(ROW_KIND), *(F.col(f"_c.row.{f.name}").alias(f.name) for f in schema))


def _image(kind: int, row: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), row.alias("row"))


def _by_operation(operation: Column, insert: list[str], update: list[str], delete: list[str], before: Column, after: Column) -> Column:
    return (
        F.when(operation.isin(*insert), F.array(_image(INSERT, after)))
        .when(operation.isin(*update), F.array(_image(UPDATE_BEFORE, before), _image(UPDATE_AFTER, after)))
        .when(operation.isin(*delete), F.array(_image(DELETE, before)))
    )


def debezium_decode(df: DataFrame, value: str, schema: T.StructType, *, lenient: bool = False) -> DataFrame:
    """before / after images with op c, r, u or d; a tombstone (NULL value) is left out."""
    envelope = T.StructType([T.StructField("before", schema), T.StructField("after", schema), T.StructField("op", T.StringType())])
    rows = df.where(F.col(value).isNotNull()).withColumn("_e", F.from_json(_text(value), envelope, _mode(lenient)))
    return _enveloped(rows, value, schema, "_e.op", (["c", "r"], ["u"], ["d"]))


def ogg_decode(df: DataFrame, value: str, schema: T.StructType, *, lenient: bool = False) -> DataFrame:
    """before / after images with op_type I, U or D."""
    envelope = T.StructType([T.StructField("before", schema), T.StructField("after", schema), T.StructField("op_type", T.StringType())])
    rows = df.where(F.col(value).isNotNull()).withColumn("_e", F.from_json(_text(value), envelope, _mode(lenient)))
    return _enveloped(rows, value, schema, "_e.op_type", (["I"], ["U"], ["D"]))


def _enveloped(rows: DataFrame, value: str, schema: T.StructType, op: str, names: tuple[list[str], list[str], list[str]]) -> DataFrame:
    known = rows.where(F.col(op).isin(*names[0], *names[1], *names[2]))
    out = _changes(known, value, schema, _by_operation(F.col(op), *names, F.col("_e.before"), F.col("_e.after")))
    return out.drop("_e")


def _patched(schema: T.StructType, data: Column, old: Column, old_json: Column) -> Column:
    """The row before an update: a field named in ``old`` has the old value, even NULL; others are unchanged."""
    keys = F.coalesce(F.json_object_keys(old_json), F.array().cast("array<string>"))
    return F.struct(*(F.when(F.array_contains(keys, f.name), old[f.name]).otherwise(data[f.name]).alias(f.name) for f in schema))


def maxwell_decode(df: DataFrame, value: str, schema: T.StructType, *, lenient: bool = False) -> DataFrame:
    """data, partial old, and type insert, update or delete."""
    envelope = T.StructType([T.StructField("data", schema), T.StructField("old", schema), T.StructField("type", T.StringType())])
    rows = df.where(F.col(value).isNotNull()).withColumn("_e", F.from_json(_text(value), envelope, _mode(lenient)))
    known = rows.where(F.col("_e.type").isin("insert", "update", "delete"))
    data = F.struct(*(F.col(f"_e.data.{f.name}").alias(f.name) for f in schema))
    before = _patched(schema, F.col("_e.data"), F.col("_e.old"), F.get_json_object(_text(value), "$.old"))
    images = (
        F.when(F.col("_e.type") == "insert", F.array(_image(INSERT, data)))
        .when(F.col("_e.type") == "update", F.array(_image(UPDATE_BEFORE, before), _image(UPDATE_AFTER, data)))
        .otherwise(F.array(_image(DELETE, data)))
    )
    return _changes(known, value, schema, images).drop("_e")


def canal_decode(df: DataFrame, value: str, schema: T.StructType, *, lenient: bool = False) -> DataFrame:
    """Arrays data and old (partial), and type INSERT, UPDATE or DELETE."""
    envelope = T.StructType([T.StructField("data", T.ArrayType(schema)), T.StructField("old", T.ArrayType(schema)), T.StructField("type", T.StringType())])
    rows = df.where(F.col(value).isNotNull()).withColumn("_e", F.from_json(_text(value), envelope, _mode(lenient)))
    known = rows.where(F.col("_e.type").isin("INSERT", "UPDATE", "DELETE"))
    parts = F.from_json(F.get_json_object(_text(value), "$.old"), "array<map<string,string>>")
    keep = [c for c in known.columns if c not in (value, "_e")]
    each = known.select(*keep, F.col("_e.type").alias("_type"), F.posexplode("_e.data").alias("_i", "_d"), F.col("_e.old").alias("_o"), parts.alias("_p"))
    each = each.withColumn("_keys", F.coalesce(F.map_keys(F.get("_p", F.col("_i"))), F.array().cast("array<string>"))).withColumn("_was", F.get("_o", F.col("_i")))
    data = F.struct(*(F.col(f"_d.{f.name}").alias(f.name) for f in schema))
    before = F.struct(*(F.when(F.array_contains("_keys", f.name), F.col(f"_was.{f.name}")).otherwise(F.col(f"_d.{f.name}")).alias(f.name) for f in schema))
    images = (
        F.when(F.col("_type") == "INSERT", F.array(_image(INSERT, data)))
        .when(F.col("_type") == "UPDATE", F.array(_image(UPDATE_BEFORE, before), _image(UPDATE_AFTER, data)))
        .otherwise(F.array(_image(DELETE, data)))
    )
    return _changes(each.withColumn(value, F.lit(None)), value, schema, images).select(*keep, ROW_KIND, *schema.names)


def debezium_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each change as an envelope: puts are op c with an after image, removals op d with a before image."""
    row = F.struct(*columns)
    put = F.col(ROW_KIND).isin(INSERT, UPDATE_AFTER)
    envelope = F.struct(F.when(~put, row).alias("before"), F.when(put, row).alias("after"), F.when(put, "c").otherwise("d").alias("op"))
    return df.select(F.to_json(envelope, {"ignoreNullFields": "false"}).alias("value"))


def upsert_encode(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Messages of a compacted topic: key and value as JSON; a removal is a tombstone, a -U is left out."""
    rows = df.where(F.col(ROW_KIND) != UPDATE_BEFORE)
    return rows.select(json_encode(keys).alias("key"), F.when(F.col(ROW_KIND) != DELETE, json_encode(columns)).alias("value"))
