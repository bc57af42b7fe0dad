"""Avro, Confluent-framed Avro and Protobuf payloads, over Arrow batches (no connector jars are needed).

Schemas are fixed.  Avro's is derived from the table's: a nullable field is a union with null first.
Protobuf's is a list of ``Field``; NULL and absent fields are told apart only where the wire does: an absent
scalar decodes to its default, an absent message to NULL.  Malformed payloads fail; NULL payloads stay NULL.
"""

from __future__ import annotations

import datetime
import decimal
import json
import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = datetime.datetime(1970, 1, 1)
_DAY = datetime.date(1970, 1, 1)


# -- varints ----------------------------------------------------------------------------------------------


def put_varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("bad varint")
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n & ((1 << 64) - 1), at


def zigzag(n: int) -> int:
    return (n << 1) ^ (n >> 63)


def unzigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def _signed(n: int, bits: int = 64) -> int:
    n &= (1 << bits) - 1
    return n - (1 << bits) if n >> (bits - 1) else n


# -- Avro -------------------------------------------------------------------------------------------------


def avro_schema(kind: T.DataType, nullable: bool = False, name: str = "record"):
    """The Avro schema of a Spark type, as JSON values."""
    plain = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "bytes"}
    if type(kind) in plain:
        out = plain[type(kind)]
    elif isinstance(kind, T.DecimalType):
        out = {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    elif isinstance(kind, T.DateType):
        out = {"type": "int", "logicalType": "date"}
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        out = {"type": "long", "logicalType": "timestamp-micros" if isinstance(kind, T.TimestampType) else "local-timestamp-micros"}
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": avro_schema(kind.elementType, kind.containsNull, name + "_item")}
    elif isinstance(kind, T.MapType):
        out = {"type": "map", "values": avro_schema(kind.valueType, kind.valueContainsNull, name + "_value")}
    elif isinstance(kind, T.StructType):
        out = {"type": "record", "name": name, "fields": [{"name": f.name, "type": avro_schema(f.dataType, f.nullable, f"{name}_{f.name}")} for f in kind]}
    else:
        raise ValueError(f"no Avro type for {kind.simpleString()}")
    return ["null", out] if nullable else out


def _take(data: bytes, at: int, n: int) -> tuple[bytes, int]:
    if n < 0 or at + n > len(data):
        raise ValueError("payload ends early")
    return data[at : at + n], at + n


def avro_put(kind: T.DataType, nullable: bool, v) -> bytes:
    if nullable:
        return b"\x00" if v is None else b"\x02" + avro_put(kind, False, v)
    if v is None:
        raise ValueError("NULL in a field that is not nullable")
    if isinstance(kind, T.BooleanType):
        return b"\x01" if v else b"\x00"
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return put_varint(zigzag(int(v)))
    if isinstance(kind, T.FloatType | T.DoubleType):
        return struct.pack("<f" if isinstance(kind, T.FloatType) else "<d", v)
    if isinstance(kind, T.StringType | T.BinaryType):
        raw = v.encode() if isinstance(v, str) else bytes(v)
        return put_varint(zigzag(len(raw))) + raw
    if isinstance(kind, T.DecimalType):
        n = int(decimal.Decimal(v).scaleb(kind.scale).to_integral_value(decimal.ROUND_HALF_UP, decimal.Context(60)))
        raw = n.to_bytes((n if n >= 0 else ~n).bit_length() // 8 + 1, "big", signed=True)
        return put_varint(zigzag(len(raw))) + raw
    if isinstance(kind, T.DateType):
        return put_varint(zigzag((v - _DAY).days))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        d = v.replace(tzinfo=None) - _EPOCH
        return put_varint(zigzag((d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds))
    if isinstance(kind, T.ArrayType):
        items = list(v)
        return (put_varint(zigzag(len(items))) + b"".join(avro_put(kind.elementType, kind.containsNull, x) for x in items) if items else b"") + b"\x00"
    if isinstance(kind, T.MapType):
        items = list(dict(v).items())
        return (put_varint(zigzag(len(items))) + b"".join(avro_put(T.StringType(), False, k) + avro_put(kind.valueType, kind.valueContainsNull, x) for k, x in items) if items else b"") + b"\x00"
    return b"".join(avro_put(f.dataType, f.nullable, v[f.name]) for f in kind)


def avro_get(kind: T.DataType, nullable: bool, data: bytes, at: int):
    if nullable:
        branch, at = get_varint(data, at)
        if branch not in (0, 2):
            raise ValueError("a union of other branches")
        return (None, at) if branch == 0 else avro_get(kind, False, data, at)
    if isinstance(kind, T.BooleanType):
        raw, at = _take(data, at, 1)
        return raw == b"\x01", at
    if isinstance(kind, T.FloatType | T.DoubleType):
        size = 4 if isinstance(kind, T.FloatType) else 8
        raw, at = _take(data, at, size)
        return struct.unpack("<f" if size == 4 else "<d", raw)[0], at
    if isinstance(kind, T.StructType):
        out = {}
        for f in kind:
            out[f.name], at = avro_get(f.dataType, f.nullable, data, at)
        return out, at
    n, at = get_varint(data, at)
    n = unzigzag(n)
    if isinstance(kind, T.ArrayType | T.MapType):
        items = []
        while n:
            if n < 0:  # a block with its size in bytes
                n, (_, at) = -n, get_varint(data, at)
            for _ in range(n):
                if isinstance(kind, T.MapType):
                    key, at = avro_get(T.StringType(), False, data, at)
                    value, at = avro_get(kind.valueType, kind.valueContainsNull, data, at)
                    items.append((key, value))
                else:
                    value, at = avro_get(kind.elementType, kind.containsNull, data, at)
                    items.append(value)
            n, at = get_varint(data, at)
            n = unzigzag(n)
        return (dict(items) if isinstance(kind, T.MapType) else items), at
    if isinstance(kind, T.StringType | T.BinaryType | T.DecimalType):
        raw, at = _take(data, at, n)
        if isinstance(kind, T.DecimalType):
            return decimal.Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-kind.scale, decimal.Context(60)), at
        return (raw.decode() if isinstance(kind, T.StringType) else raw), at
    if isinstance(kind, T.DateType):
        return _DAY + datetime.timedelta(days=n), at
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return _EPOCH + datetime.timedelta(microseconds=n), at
    return n, at


def _decoder(schema: T.StructType, one: Callable[[bytes], dict]):
    """Each payload as JSON text that Spark's own parser turns into the schema's row."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, bytes):
            import base64

            return base64.b64encode(v).decode()
        if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
            return str(v).replace("inf", "Infinity").replace("nan", "NaN")
        return str(v) if isinstance(v, decimal.Decimal | datetime.date | datetime.datetime) else v

    @F.arrow_udf("string")
    def decode(values: pa.Array) -> pa.Array:
        return pa.array([None if b is None else json.dumps(plain(one(b))) for b in values.to_pylist()], pa.string())

    return lambda value: F.from_json(decode(value), schema, {"mode": "FAILFAST", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "timestampFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"})


def _value(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def avro_decode(value: Column | str, schema: T.StructType, *, confluent: bool = False) -> Column:
    """A bare datum, or one behind a zero byte and a four-byte schema id."""

    def one(data: bytes) -> dict:
        if confluent:
            if data[:1] != b"\x00" or len(data) < 5:
                raise ValueError("not a framed payload")
            data = data[5:]
        row, at = avro_get(schema, False, data, 0)
        if at != len(data):
            raise ValueError("bytes after the datum")
        return row

    return _decoder(schema, one)(_value(value))


def avro_encode(columns: list[str], schema: T.StructType, *, schema_id: int | None = None) -> Column:
    """A bare datum; with a schema id, the framed form.  ``columns`` are the schema's, in order."""
    head = b"" if schema_id is None else struct.pack(">BI", 0, schema_id)

    @F.arrow_udf("binary")
    def encode(rows: pa.Array) -> pa.Array:
        return pa.array([head + avro_put(schema, False, row) for row in rows.to_pylist()], pa.binary())

    return encode(F.struct(*(F.col(c).alias(n) for c, n in zip(columns, schema.names, strict=True))))


class Registry:
    """Schema ids by subject, for framed payloads where no registry can be reached: ids are given here."""

    def __init__(self):
        self._ids: dict[str, int] = {}

    def register(self, subject: str, schema: T.StructType) -> int:
        text = json.dumps([subject, avro_schema(schema)], sort_keys=True)
        return self._ids.setdefault(text, len(self._ids) + 1)


# -- Protobuf ---------------------------------------------------------------------------------------------

#: Wire types of scalar kinds.
_WIRE = {"int32": 0, "int64": 0, "uint32": 0, "uint64": 0, "sint32": 0, "sint64": 0, "bool": 0, "enum": 0, "fixed64": 1, "sfixed64": 1, "double": 1, "string": 2, "bytes": 2, "message": 2, "fixed32": 5, "sfixed32": 5, "float": 5}
_PACK = {"fixed64": "<Q", "sfixed64": "<q", "double": "<d", "fixed32": "<I", "sfixed32": "<i", "float": "<f"}


@dataclass(frozen=True)
class Field:
    """A message's field.  ``fields`` of a nested message, ``symbols`` of an enum by number; ``optional`` tracks presence."""

    name: str
    number: int
    kind: str
    repeated: bool = False
    optional: bool = False
    fields: tuple[Field, ...] = ()
    symbols: dict[int, str] = field(default_factory=dict, hash=False)


def protobuf_type(fields: tuple[Field, ...]) -> T.StructType:
    """The table's type; unsigned integers keep their bits in the signed type of their width."""
    plain = {"int32": T.IntegerType(), "sint32": T.IntegerType(), "sfixed32": T.IntegerType(), "uint32": T.IntegerType(), "fixed32": T.IntegerType(), "int64": T.LongType(), "sint64": T.LongType(), "sfixed64": T.LongType(), "uint64": T.LongType(), "fixed64": T.LongType(), "bool": T.BooleanType(), "enum": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType(), "bytes": T.BinaryType()}
    out = []
    for f in fields:
        kind = protobuf_type(f.fields) if f.kind == "message" else plain[f.kind]
        out.append(T.StructField(f.name, T.ArrayType(kind) if f.repeated else kind))
    return T.StructType(out)


def _default(f: Field):
    if f.repeated:
        return []
    if f.optional or f.kind == "message":
        return None
    return {"bool": False, "string": "", "bytes": b"", "double": 0.0, "float": 0.0, "enum": f.symbols.get(0, "0")}.get(f.kind, 0)


def _scalar(f: Field, wire: int, data: bytes, at: int):
    if wire == 0:
        n, at = get_varint(data, at)
        if f.kind in ("sint32", "sint64"):
            return unzigzag(n), at
        if f.kind == "bool":
            return bool(n), at
        if f.kind == "enum":
            n = _signed(n, 32)
            return f.symbols.get(n, str(n)), at
        return _signed(n, 32 if f.kind.endswith("32") else 64), at
    if wire in (1, 5):
        size = 8 if wire == 1 else 4
        raw, at = _take(data, at, size)
        v = struct.unpack(_PACK[f.kind], raw)[0]
        return (_signed(v, size * 8) if f.kind in ("fixed32", "fixed64") else v), at
    n, at = get_varint(data, at)
    raw, at = _take(data, at, n)
    return (raw.decode() if f.kind == "string" else raw if f.kind == "bytes" else protobuf_get(f.fields, raw)), at


def protobuf_get(fields: tuple[Field, ...], data: bytes) -> dict:
    known = {f.number: f for f in fields}
    out, at = {f.name: _default(f) for f in fields}, 0
    while at < len(data):
        tag, at = get_varint(data, at)
        number, wire = tag >> 3, tag & 7
        f = known.get(number)
        if f is None:  # fields that the table does not have
            if wire == 0:
                _, at = get_varint(data, at)
            elif wire in (1, 5):
                _, at = _take(data, at, 8 if wire == 1 else 4)
            elif wire == 2:
                n, at = get_varint(data, at)
                _, at = _take(data, at, n)
            else:
                raise ValueError(f"wire type {wire}")
        elif f.repeated and wire == 2 and _WIRE[f.kind] != 2:  # packed
            n, at = get_varint(data, at)
            raw, at = _take(data, at, n)
            i = 0
            while i < len(raw):
                v, i = _scalar(f, _WIRE[f.kind], raw, i)
                out[f.name].append(v)
        elif wire != _WIRE[f.kind]:
            raise ValueError(f"field {f.name} has wire type {wire}")
        else:
            v, at = _scalar(f, wire, data, at)
            if f.repeated:
                out[f.name].append(v)
            elif f.kind == "message" and out[f.name] is not None:  # later parts are merged in
                out[f.name] |= {k: x for k, x in v.items() if x not in (None, [], _default(next(g for g in f.fields if g.name == k)))}
            else:
                out[f.name] = v
    return out


def _put_scalar(f: Field, v) -> bytes:
    if f.kind == "message":
        raw = protobuf_put(f.fields, v)
        return put_varint(len(raw)) + raw
    if f.kind in ("string", "bytes"):
        raw = v.encode() if isinstance(v, str) else bytes(v)
        return put_varint(len(raw)) + raw
    if f.kind in _PACK:
        return struct.pack(_PACK[f.kind], v & ((1 << (8 * struct.calcsize(_PACK[f.kind]))) - 1) if f.kind in ("fixed32", "fixed64") else v)
    if f.kind == "enum":
        return put_varint(next((n for n, s in f.symbols.items() if s == v), None) if v in f.symbols.values() else int(v))
    if f.kind in ("sint32", "sint64"):
        return put_varint(zigzag(int(v)))
    return put_varint(int(v) & 0xFFFFFFFF if f.kind == "uint32" else int(v))


def protobuf_put(fields: tuple[Field, ...], row: dict) -> bytes:
    out = b""
    for f in sorted(fields, key=lambda g: g.number):
        v = row[f.name]
        if v is None or f.repeated and not len(v) or not f.repeated and not f.optional and f.kind != "message" and v == _default(f) and str(v) != "-0.0":
            continue
        if f.repeated and _WIRE[f.kind] != 2:
            raw = b"".join(_put_scalar(f, x) for x in v)
            out += put_varint(f.number << 3 | 2) + put_varint(len(raw)) + raw
        else:
            out += b"".join(put_varint(f.number << 3 | _WIRE[f.kind]) + _put_scalar(f, x) for x in (v if f.repeated else [v]))
    return out


def protobuf_decode(value: Column | str, fields: tuple[Field, ...]) -> Column:
    return _decoder(protobuf_type(fields), lambda data: protobuf_get(fields, data))(_value(value))


def protobuf_encode(columns: list[str], fields: tuple[Field, ...]) -> Column:
    names = [f.name for f in fields]

    @F.arrow_udf("binary")
    def encode(rows: pa.Array) -> pa.Array:
        return pa.array([protobuf_put(fields, row) for row in rows.to_pylist()], pa.binary())

    return encode(F.struct(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True))))
