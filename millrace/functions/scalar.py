"""Scalar expressions whose semantics differ from Spark's own.

All are built-in column expressions, but for divisions of decimals of unknown types; none depends on the session's ANSI mode.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from millrace.types import INTEGERS, limits


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- integers -----------------------------------------------------------------------------------------


def wrap(x: Column | str, to: str) -> Column:
    """Two's-complement narrowing of an integer (or an exact decimal) to an integer type."""
    x, bits = _col(x), INTEGERS[to]
    if bits == 64:
        span = F.lit(str(1 << 64)).cast("decimal(38,0)")
        m = F.pmod(x.cast("decimal(38,0)"), span)
        return F.when(m >= F.lit(str(1 << 63)).cast("decimal(38,0)"), m - span).otherwise(m).cast("bigint")
    m = F.pmod(x.cast("bigint"), F.lit(1 << bits).cast("bigint"))
    return F.when(m >= 1 << (bits - 1), m - (1 << bits)).otherwise(m).cast(to)


def _wide(x: Column | str, to: str) -> Column:
    return _col(x).cast("decimal(38,0)" if to == "bigint" else "bigint")


def add(a: Column | str, b: Column | str, to: str) -> Column:
    """a + b, wrapped to the declared type."""
    return wrap(_wide(a, to) + _wide(b, to), to)


def subtract(a: Column | str, b: Column | str, to: str) -> Column:
    return wrap(_wide(a, to) - _wide(b, to), to)


def multiply(a: Column | str, b: Column | str, to: str) -> Column:
    """a * b, wrapped; BIGINT operands are split so that no partial product leaves 38 digits."""
    if to != "bigint":
        return wrap(_wide(a, to) * _wide(b, to), to)
    wide = lambda x: x.cast("decimal(20,0)")
    low = F.pmod(wide(_col(b)), F.lit(1 << 32).cast("decimal(20,0)")).cast("decimal(10,0)")
    high = F.shiftright(_col(b), 32).cast("decimal(10,0)")
    upper = F.pmod((_col(a).cast("decimal(20,0)") * high).cast("decimal(38,0)"), F.lit(1 << 32).cast("decimal(38,0)"))
    return wrap((_col(a).cast("decimal(20,0)") * low).cast("decimal(38,0)") + (upper * F.lit(1 << 32).cast("decimal(11,0)")).cast("decimal(38,0)"), to)


def divide(a: Column | str, b: Column | str, to: str) -> Column:
    """Integer division toward zero; division by zero fails."""
    zero = F.raise_error(F.lit("division by zero")).cast("bigint")
    quotient = F.call_function("div", _wide(a, "int"), F.when(_col(b) == 0, zero).otherwise(_wide(b, "int")))
    return wrap(quotient, to)


def modulo(a: Column | str, b: Column | str) -> Column:
    """The remainder with the dividend's sign; a zero divisor fails."""
    return _col(a) % _nonzero(_col(b))


def _nonzero(b: Column, to: str | None = None) -> Column:
    failed = F.raise_error(F.lit("division by zero"))
    return F.when(b == 0, failed.cast(to) if to else failed).otherwise(b)


# -- decimals ------------------------------------------------------------------------------------------

Precision = tuple[int, int]


def decimal_op(a: Column | str, op: str, b: Column | str, precision: int, scale: int, *, types: tuple[Precision, Precision] | None = None) -> Column:
    """An exact operation, half up to the declared type; overflow is NULL, division by zero fails.

    types: precision and scale of both operands.  Division needs them to stay in built-in expressions, and 38 digits
    that hold the quotient's whole digits and one more than the scale; otherwise it runs in Python on Arrow batches.
    """
    a, b = _col(a), _col(b)
    if op == "/":
        if types:
            (p1, s1), (p2, s2) = types
            whole, more = p1 - s1 + s2, max(0, scale - s1 - p2)
            if whole + max(scale, s1 + more + p2) + 1 <= 38 and p1 + more <= 38 and whole + scale + p2 + 3 <= 38:
                divisor = _nonzero(b.cast(f"decimal({p2},{s2})"), f"decimal({p2},{s2})")
                wide = a.cast(f"decimal({p1 + more},{s1 + more})")  # the quotient's scale follows the dividend's
                twice = F.try_divide(wide, divisor).cast(f"decimal({whole + scale + 1},{scale})")  # rounded to more digits, then to these
                over = F.abs(twice) * F.abs(divisor) - F.abs(a.cast(f"decimal({p1},{s1})"))
                unit = F.lit(Decimal(1).scaleb(-scale))
                return F.when(over + over > F.abs(divisor) * unit, twice - unit * F.signum(twice).cast("decimal(1,0)")).otherwise(twice).try_cast(f"decimal({precision},{scale})")
        return _quotient(precision, scale)(a.cast("string"), b.cast("string"))
    out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % _nonzero(b)}[op]()
    return out.try_cast(f"decimal({precision},{scale})")


def _quotient(precision: int, scale: int):
    """Division of decimals given as text, of any precision."""
    from millrace.functions.udf import scalar

    unit, most = Decimal(1).scaleb(-scale), Decimal(10) ** (precision - scale)

    def divide(a, b):
        if a is None or b is None:
            return None
        with localcontext(prec=120):
            a, b = Decimal(a), Decimal(b)
            if not b:
                raise ZeroDivisionError("division by zero")
            out = (a / b).quantize(unit, ROUND_HALF_UP)
            return out if abs(out) < most else None

    return scalar(divide, f"decimal({precision},{scale})")


def to_decimal(x: Column | str, precision: int, scale: int) -> Column:
    """Half up; what doesn't fit is NULL."""
    return _col(x).try_cast(f"decimal({precision},{scale})")


# -- casts ----------------------------------------------------------------------------------------------


def float_to_int(x: Column | str, to: str) -> Column:
    """Toward zero, saturating at the target's limits; NaN is 0."""
    x = _col(x).cast("double")
    low, high = limits(to)
    inside = F.when(x.isNull() | F.isnan(x) | (x >= float(high)) | (x <= float(low)), None).otherwise(x)
    return F.when(x.isNull(), None).when(F.isnan(x), F.lit(0).cast(to)).when(x >= float(high), F.lit(high).cast(to)).when(x <= float(low), F.lit(low).cast(to)).otherwise(inside.cast("bigint").cast(to))


def parse(x: Column | str, to: str) -> Column:
    """A string as a number; one that can't be read fails the query."""
    x = _col(x)
    got = F.trim(x).try_cast(to)
    return F.when(x.isNotNull() & got.isNull(), F.raise_error(F.concat(F.lit(f"not a {to}: "), x)).cast(to)).otherwise(got)


def to_varchar(x: Column | str, n: int) -> Column:
    """At most n characters."""
    return F.substring(_col(x).cast("string"), 1, n)


def to_char(x: Column | str, n: int) -> Column:
    """Exactly n characters, padded with blanks."""
    return F.rpad(_col(x).cast("string"), n, " ")


# -- strings --------------------------------------------------------------------------------------------


def split_index(x: Column | str, separator: str, index: Column | int) -> Column:
    """The piece at an index from 0; NULL for an empty string, a negative index or one past the end."""
    if not separator:
        raise ValueError("the separator must not be empty")
    index = index if isinstance(index, Column) else F.lit(index)
    parts = F.split(_col(x), re.escape(separator), -1)
    return F.when((_col(x) != "") & (index >= 0), F.get(parts, index.cast("int")))


def regexp_extract(x: Column | str, pattern: str, group: int = 0) -> Column:
    """The group of the first match; NULL without a match, for an optional group that took no part, a bad pattern or a bad group.

    Patterns are java.util.regex's.
    """
    groups = _groups(pattern)
    if groups is None or not 0 <= group <= groups:
        return F.lit(None).cast("string")
    x = _col(x)
    found = F.regexp_extract(x, pattern, group)
    if not group:
        return F.when(x.rlike(pattern), found)
    # an empty result: at the first match, a reference to a group that took no part fails, one to an empty group doesn't
    took_part = x.rlike(rf"\A(?>[\s\S]*?(?=(?:{pattern})))\{group}")
    return F.coalesce(F.nullif(found, F.lit("")), F.when(x.rlike(pattern) & took_part, ""))


def _groups(pattern: str) -> int | None:
    """How many groups the pattern has; None for a bad one."""
    session = SparkSession.getActiveSession()
    jvm = getattr(getattr(session, "sparkContext", None), "_jvm", None)
    if jvm is None:  # no JVM of our own to ask
        try:
            return re.compile(pattern).groups
        except re.error:
            return None
    try:
        return jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except IllegalArgumentException:
        return None


def position(part: Column | str, x: Column | str) -> Column:
    """1-based, 0 where it is absent."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.call_function("locate", part, _col(x))


def count_char(x: Column | str, c: str) -> Column:
    """How often a character stands in a string; 0 for NULL."""
    x = F.coalesce(_col(x), F.lit(""))
    return (F.char_length(x) - F.char_length(F.replace(x, F.lit(c), F.lit("")))).cast("bigint")


# -- collections ----------------------------------------------------------------------------------------


def item(x: Column | str, key) -> Column:
    """An array's element from 1, or a map's value; NULL where there is none."""
    return F.try_element_at(_col(x), F.lit(key))


# -- floats ---------------------------------------------------------------------------------------------


def floor(x: Column | str) -> Column:
    """FLOOR of a DOUBLE stays DOUBLE, beyond BIGINT too."""
    x = _col(x).cast("double")
    return F.when(F.abs(x) < float(1 << 52), F.floor(F.when(F.abs(x) < float(1 << 52), x)).cast("double")).otherwise(x)


def ceil(x: Column | str) -> Column:
    x = _col(x).cast("double")
    return F.when(F.abs(x) < float(1 << 52), F.ceil(F.when(F.abs(x) < float(1 << 52), x)).cast("double")).otherwise(x)


# -- time -----------------------------------------------------------------------------------------------


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp with or without zone (UTC session)."""
    return F.unix_millis(_col(ts).cast("timestamp"))


def epoch_ms_nearest(ts: Column | str) -> Column:
    """The nearest millisecond since 1970, halves away from 1970, as DuckDB's ``epoch_ms`` gives it."""
    us = F.unix_micros(_col(ts).cast("timestamp"))
    rest = us % 1000
    return F.call_function("div", us, F.lit(1000)) + F.when(rest >= 500, 1).when(rest <= -500, -1).otherwise(0)


def to_timestamp_ltz(ms: Column | str) -> Column:
    return F.timestamp_millis(_col(ms))


def ntz_from_ms(ms: Column | str) -> Column:
    return F.timestamp_millis(_col(ms)).cast("timestamp_ntz")


def date_format(ts: Column | str, pattern: str) -> Column:
    return F.date_format(_col(ts), pattern)


def extract(field: str, ts: Column | str) -> Column:
    """YEAR, MONTH, DAY, HOUR, MINUTE or SECOND as BIGINT; SECOND is whole."""
    parts = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second}
    return parts[field.upper()](_col(ts)).cast("bigint")
