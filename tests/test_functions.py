"""Scalar functions, casts and aggregates on small fixtures."""

import datetime
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import types
from millrace.functions import aggregates as A
from millrace.functions import scalar as S
from millrace.functions import udf


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.ansi.enabled", old)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_narrow_integers_wrap(spark, ansi):
    t = lambda v, k: F.lit(v).cast(k)
    assert one(spark, S.add(t(100, "tinyint"), t(100, "tinyint"), "tinyint"), S.multiply(t(300, "smallint"), t(300, "smallint"), "smallint"), S.subtract(t(-2147483648, "int"), t(1, "int"), "int")) == (-56, 24464, 2147483647)
    big = F.lit(9223372036854775807)
    assert one(spark, S.add(big, F.lit(1).cast("bigint"), "bigint"), S.multiply(big, big, "bigint"), S.multiply(F.lit(-3).cast("bigint"), F.lit(7).cast("bigint"), "bigint")) == (-9223372036854775808, 1, -21)


@pytest.mark.parametrize("a,b", [(123456789012345, 987654321098765), (-5, 2**62), (-(2**63), -1), (2**63 - 1, -(2**63))])
def test_bigint_multiply(spark, ansi, a, b):
    want = (a * b + 2**63) % 2**64 - 2**63
    df = spark.createDataFrame([(a, b)], "a bigint, b bigint")
    assert df.select(S.multiply("a", "b", "bigint")).first()[0] == want


def test_division_truncates_and_fails_on_zero(spark, ansi):
    assert one(spark, S.divide(F.lit(-7), F.lit(2), "int"), S.modulo(F.lit(-7), F.lit(3))) == (-3, -1)
    with pytest.raises(Exception, match="division by zero"):
        one(spark, S.divide(F.lit(1), F.lit(0), "int"))


def test_casts(spark, ansi):
    df = spark.createDataFrame([(300, 3.9), (2147483648, -3.9), (4294967297, 1e20), (-5, -1e20), (42, float("nan")), (1, float("inf")), (-1, float("-inf")), (None, None)], "big bigint, dbl double")
    got = [tuple(r) for r in df.select(S.wrap("big", "int"), S.wrap("big", "tinyint"), S.float_to_int("dbl", "int"), S.float_to_int("dbl", "tinyint"), S.float_to_int("dbl", "bigint")).collect()]
    high, low = 2147483647, -2147483648
    top, bottom = 2**63 - 1, -(2**63)
    assert got == [(300, 44, 3, 3, 3), (low, 0, -3, -3, -3), (1, 1, high, 127, top), (-5, -5, low, -128, bottom), (42, 42, 0, 0, 0), (1, 1, high, 127, top), (-1, -1, low, -128, bottom), (None,) * 5]


def test_parse_fails_loudly(spark, ansi):
    assert one(spark, S.parse(F.lit(" 12 "), "int")) == (12,)
    with pytest.raises(Exception, match="not a int"):
        one(spark, S.parse(F.lit("x"), "int"))


def test_decimals(spark, ansi):
    dec = lambda v, p, s: F.lit(v).cast(f"decimal({p},{s})")
    assert one(spark, S.decimal_op(dec("1.005", 10, 3), "+", dec("0", 10, 0), 10, 2), S.decimal_op(dec("99", 10, 0), "*", dec("99", 10, 0), 3, 0), S.decimal_op(dec("1", 10, 0), "/", dec("3", 10, 0), 10, 4)) == (Decimal("1.01"), None, Decimal("0.3333"))


def test_strings(spark, ansi):
    assert one(spark, S.to_varchar(F.lit("abcdef"), 3), S.to_char(F.lit("ab"), 4), S.count_char(F.lit("banana"), "a"), S.count_char(F.lit(None).cast("string"), "a"), S.position("n", F.lit("banana"))) == ("abc", "ab  ", 3, 0, 3)
    split = lambda v, i: S.split_index(F.lit(v), "/", i)
    assert one(spark, split("a/b/c", 1), split("a//c", 1), split("", 0), split("a", 5), split("a", -1)) == ("b", "", None, None, None)
    take = S.regexp_extract
    assert one(spark, take(F.lit("x12"), r"\d+"), take(F.lit("x"), r"\d+"), take(F.lit("a"), r"a(b)?", 1), take(F.lit("a"), "(", 0), take(F.lit("a"), "a", 3)) == ("12", None, None, None, None)


def test_items_and_floats(spark, ansi):
    array = F.array(F.lit(10), F.lit(20))
    assert one(spark, S.item(array, 2), S.item(array, 3), S.floor(F.lit(-1.4)), S.ceil(F.lit(2.5)), S.floor(F.lit(1e300))) == (20, None, -2.0, 3.0, 1e300)


def test_aggregates(spark, ansi):
    data = [(7, 1, 10, 1.5, 100, 3), (7, 2, 20, 2.5, -7, -2), (9, 3, 30, 3.0, 250, 9), (7, 4, 40, 4.5, 42, 5), (9, 5, 50, 5.5, -11, -4)]
    df = spark.createDataFrame(data, "k bigint, v bigint, q int, p double, vs smallint, vt tinyint")
    got = rows(df.groupBy("k").agg(A.sum_("vs", "smallint"), A.avg_int("vt", "tinyint"), A.avg_int("v", "bigint"), A.count(when=F.col("v") > 2), A.sum_distinct("q")))
    assert got == [(7, 135, 2, 2, 1, 70), (9, 239, 2, 4, 2, 80)]
    narrow = spark.createDataFrame([(100, 30000), (100, 30000)], "t tinyint, s smallint")
    assert tuple(narrow.agg(A.sum_("t", "tinyint"), A.sum_("s", "smallint")).first()) == (-56, -5536)
    assert tuple(df.where("k = 0").agg(A.sum_("v", "bigint"), A.avg_int("v", "bigint"), A.count()).first()) == (None, None, 0)


def test_decimal_aggregates(spark, ansi):
    df = spark.createDataFrame([(Decimal("1.10"),), (Decimal("2.20"),), (Decimal("3.35"),)], "d decimal(10,2)")
    assert tuple(df.agg(A.sum_decimal("d", 2), A.avg_decimal("d", 2)).first()) == (Decimal("6.65"), Decimal("2.216667"))
    wide = spark.createDataFrame([(Decimal("9" * 38),), (Decimal("9" * 38),)], "d decimal(38,0)")
    assert wide.agg(A.sum_decimal("d", 0)).first()[0] is None


def test_float_sum_rounds_each_step(spark):
    import numpy as np

    want = np.float32(0)
    for _ in range(8):
        want = np.float32(want + np.float32(0.1))
    df = spark.createDataFrame([(i, 0.1) for i in range(8)], "i int, f float").orderBy("i")
    assert df.agg(A.sum_float(F.collect_list("f"))).first()[0] == float(want)


def test_types():
    assert types.spark_type("ARRAY<ROW<a BIGINT, b VARCHAR(3)>>") == T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())]))
    assert types.spark_type("MULTISET<STRING>") == T.MapType(T.StringType(), T.IntegerType(), False)
    assert types.spark_type("DECIMAL(12, 3)") == T.DecimalType(12, 3)
    assert types.spark_type("TIMESTAMP(3)") == T.TimestampNTZType() and types.spark_type("TIMESTAMP_LTZ(3)") == T.TimestampType()
    with pytest.raises(ValueError):
        types.spark_type("RAW")


def test_time(spark):
    ts = F.lit(datetime.datetime(2026, 8, 21, 12, 34, 56, 789000)).cast("timestamp_ntz")
    assert one(spark, S.epoch_ms(ts), S.extract("SECOND", ts), S.date_format(ts, "yyyy HH:mm")) == (1787315696789, 56, "2026 12:34")


def test_scalar_udf(spark):
    f = udf.scalar(lambda a, b: None if a is None else a * b, "bigint")
    df = spark.createDataFrame([(2, 3), (None, 4)], "a bigint, b bigint")
    assert [r[0] for r in df.select(f("a", "b")).collect()] == [6, None]
    with pytest.raises(ValueError):
        udf.scalar(len, "array<int>")


def test_decimal_division(spark, ansi):
    d = lambda x, kind: F.lit(Decimal(x)).cast(f"decimal({kind})")
    third = S.decimal_op(d("1", "1,0"), "/", d("3", "1,0"), 20, 10)
    typed = S.decimal_op(d("1", "1,0"), "/", d("3", "1,0"), 20, 10, types=((1, 0), (1, 0)))
    large = S.decimal_op(d("1" + "0" * 24, "38,0"), "/", d("3", "38,10"), 38, 6)
    half, minus = S.decimal_op(d("1", "5,2"), "/", d("8", "5,2"), 10, 2, types=((5, 2), (5, 2))), S.decimal_op(d("-1", "5,2"), "/", d("8", "5,2"), 10, 2)
    over, null = S.decimal_op(d("1000", "10,2"), "/", d("0.01", "3,2"), 5, 2), S.decimal_op(F.lit(None).cast("decimal(5,2)"), "/", d("1", "1,0"), 5, 2)
    assert one(spark, third, typed, large, half, minus, over, null) == (Decimal("0.3333333333"), Decimal("0.3333333333"), Decimal("333333333333333333333333.333333"), Decimal("0.13"), Decimal("-0.13"), None, None)
    assert one(spark, S.decimal_op(d("-7.5", "3,1"), "%", d("2", "1,0"), 5, 2)) == (Decimal("-1.50"),)


@pytest.mark.parametrize("made", [lambda: S.modulo(F.lit(7), F.lit(0)), lambda: S.decimal_op(F.lit(Decimal(1)), "%", F.lit(Decimal(0)), 5, 2), lambda: S.decimal_op(F.lit(Decimal(1)), "/", F.lit(Decimal(0)), 5, 2), lambda: S.decimal_op(F.lit(Decimal(1)), "/", F.lit(Decimal(0)), 5, 2, types=((10, 0), (10, 0)))])
def test_division_by_zero_fails(spark, ansi, made):
    with pytest.raises(Exception, match="division by zero"):
        one(spark, made())


def test_regexp_extract_like_java(spark, ansi):
    x = F.lit("12 Äpfel.")
    got = one(spark, S.regexp_extract(x, r"\p{L}+"), S.regexp_extract(x, r"(\d*)(-)?( )", 2), S.regexp_extract(x, r"(x*)1", 1), S.regexp_extract(x, r"1(?<rest>y*)2", 1), S.regexp_extract(x, "("), S.regexp_extract(x, "a", 3), S.regexp_extract(x, "zzz()", 1), S.regexp_extract(x, r"(y)?1|2(y*)", 1))
    assert got == ("Äpfel", None, "", "", None, None, None, None)


def test_wrapping_sums(spark, ansi):
    data = [(2**63 - 1,), (1,), (-(2**62),), (2**62 + 5,), (None,), (-1,)]
    df = spark.createDataFrame(data, "v bigint")
    total = sum(v for (v,) in data if v is not None)
    assert df.agg(A.sum_("v", "bigint")).first()[0] == (total + 2**63) % 2**64 - 2**63
    assert df.where("v < 0").agg(A.sum_("v", "bigint"), A.sum_("v", "bigint", weight=F.lit(-1))).first()[:] == (-(2**62) - 1, 2**62 + 1)
