"""Avro and Protobuf payloads: known bytes, round trips, and refusals."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Row
from pyspark.sql import types as T

from millrace.sources import binary as B
from millrace.sources import kafka

SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("t", T.StringType()), T.StructField("d", T.DoubleType()), T.StructField("m", T.DecimalType(10, 2)),
    T.StructField("day", T.DateType()), T.StructField("at", T.TimestampNTZType()), T.StructField("xs", T.ArrayType(T.LongType())), T.StructField("ok", T.BooleanType()),
])


def test_avro_bytes():
    kind = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.StringType())])
    assert B.avro_put(kind, False, {"a": 27, "b": "foo"}) == bytes.fromhex("36 02 06 66 6f 6f")
    assert B.avro_get(kind, False, bytes.fromhex("36 00"), 0) == ({"a": 27, "b": None}, 2)
    assert B.avro_schema(kind)["fields"][1] == {"name": "b", "type": ["null", "string"]}
    for n in (0, -1, 1, 2**63 - 1, -(2**63)):
        assert B.avro_get(T.LongType(), False, B.avro_put(T.LongType(), False, n), 0)[0] == n
    with pytest.raises(ValueError):
        B.avro_get(kind, False, b"\x36\x02\x06f", 0)


@pytest.mark.parametrize("frame", [None, 7])
def test_avro_round_trip(spark, frame):
    data = [(1, "a😀", 1.5, Decimal("-3.25"), datetime.date(1969, 12, 31), datetime.datetime(1969, 12, 31, 23, 59, 59, 1), [1, None, -3], True), (2, None, None, None, None, None, None, None), (3, "", 0.0, Decimal("0.00"), datetime.date(2026, 1, 2), datetime.datetime(2026, 1, 2, 3, 4, 5), [], False)]
    wire = spark.createDataFrame(data, SCHEMA).select(B.avro_encode(SCHEMA.names, SCHEMA, schema_id=frame).alias("v"))
    if frame:
        assert bytes(wire.first()["v"])[:5] == b"\x00\x00\x00\x00\x07"
    got = wire.select(B.avro_decode("v", SCHEMA, confluent=frame is not None).alias("r")).select("r.*").orderBy("id").collect()
    assert [tuple(r) for r in got] == data


INNER = (B.Field("x", 1, "sint64"),)
FIELDS = (
    B.Field("id", 1, "int64"), B.Field("u", 2, "uint32"), B.Field("s", 3, "string"), B.Field("e", 4, "enum", symbols={0: "NONE", 2: "TWO"}), B.Field("xs", 5, "int32", repeated=True),
    B.Field("m", 6, "message", fields=INNER), B.Field("f", 7, "double"), B.Field("o", 8, "int32", optional=True), B.Field("ss", 9, "string", repeated=True), B.Field("z", 10, "fixed64"),
)


def test_protobuf_bytes():
    row = {"id": 150, "u": 0, "s": "testing", "e": "NONE", "xs": [3, 270, 86942], "m": {"x": -1}, "f": 0.0, "o": None, "ss": [], "z": 0}
    raw = B.protobuf_put(FIELDS, row)
    assert raw == bytes.fromhex("08 96 01 1a 07 74 65 73 74 69 6e 67 2a 06 03 8e 02 9e a7 05 32 02 08 01")
    assert B.protobuf_get(FIELDS, raw) == row
    assert B.protobuf_get(FIELDS, bytes.fromhex("28 03 28 04 f8 06 01 20 05"))["xs"] == [3, 4]  # unpacked, unknown field 111
    assert B.protobuf_get(FIELDS, bytes.fromhex("20 05"))["e"] == "5"
    assert B.protobuf_get(FIELDS, bytes.fromhex("10 ff ff ff ff 0f"))["u"] == -1
    with pytest.raises(ValueError):
        B.protobuf_get(FIELDS, bytes.fromhex("1a 07 74"))


def test_protobuf_round_trip(spark):
    schema = B.protobuf_type(FIELDS)
    data = [(1, -1, "é", "TWO", [1, -2], (5,), 1.5, 0, ["a", ""], -9), (0, 0, "", "NONE", [], None, 0.0, None, [], 0)]
    wire = spark.createDataFrame(data, schema).select(B.protobuf_encode(schema.names, FIELDS).alias("v"))
    got = wire.select(B.protobuf_decode("v", FIELDS).alias("r")).select("r.*").orderBy(F.desc("id")).collect()
    assert [tuple(None if v is None else tuple(v) if isinstance(v, Row) else v for v in r) for r in got] == data


def test_bad_payloads_fail(spark):
    df = spark.createDataFrame([(b"\x01",)], "v binary")
    with pytest.raises(Exception, match="payload"):
        df.select(B.avro_decode("v", SCHEMA, confluent=True)).collect()
    assert B.Registry().register("s", SCHEMA) == 1


def test_kafka_says_that_it_is_missing(spark):
    if not kafka.available(spark):
        with pytest.raises(RuntimeError, match="Kafka connector"):
            kafka.read(spark, "localhost:9092", "t")
