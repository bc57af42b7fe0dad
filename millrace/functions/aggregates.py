"""Aggregates with declared result types: truncating averages, wrapping sums, decimals, filters, retraction.

Each is an ordinary aggregate expression, so Catalyst splits it into partial and final sums.
``when`` gates an aggregate as FILTER (WHERE ...) does; ``weight`` (1 put, -1 removed) makes it retractable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.scalar import wrap


def _gated(x: Column | str, when: Column | None) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x if when is None else F.when(when, x)


def count(x: Column | str | None = None, when: Column | None = None, weight: Column | None = None) -> Column:
    one = F.lit(1) if x is None else F.when(_gated(x, None).isNotNull(), F.lit(1))
    gated = _gated(one, when)
    return F.count(gated) if weight is None else F.coalesce(F.sum(F.when(gated.isNotNull(), weight)), F.lit(0))


def sum_(x: Column | str, to: str, when: Column | None = None, weight: Column | None = None) -> Column:
    """SUM in the input's own integer type, wrapping, as stepwise wrapping would.

    Bits 0 to 21, 22 to 43 and 44 to 63 are summed apart as BIGINT, which 2^41 rows can't overflow, and put together once.
    """
    value = _gated(x, when).cast("bigint")
    low, middle, high = value.bitwiseAND(F.lit((1 << 22) - 1)), F.shiftright(value, 22).bitwiseAND(F.lit((1 << 22) - 1)), F.shiftright(value, 44)
    sums = [F.sum(part if weight is None else part * weight.cast("bigint")).cast("decimal(19,0)") for part in (low, middle, high)]
    return wrap((sums[0] + sums[1] * F.lit(1 << 22).cast("decimal(7,0)")).cast("decimal(38,0)") + (sums[2] * F.lit(1 << 44).cast("decimal(14,0)")).cast("decimal(38,0)"), to)


def sum_double(x: Column | str, when: Column | None = None) -> Column:
    return F.sum(_gated(x, when).cast("double"))


def avg_int(x: Column | str, to: str, when: Column | None = None, weight: Column | None = None) -> Column:
    """Sum over count, truncated toward zero, in the input's type; NULL without values."""
    total = sum_(x, "bigint", when, weight)
    n = count(x, when, weight)
    return F.call_function("div", total, F.when(n != 0, n)).cast(to)


def avg_float(x: Column | str, to: str = "double", when: Column | None = None) -> Column:
    return F.avg(_gated(x, when).cast("double")).cast(to)


def sum_decimal(x: Column | str, scale: int, when: Column | None = None) -> Column:
    """DECIMAL(38, scale); overflow is NULL."""
    return F.try_sum(_gated(x, when).cast(f"decimal(38,{scale})")).try_cast(f"decimal(38,{scale})")


def avg_decimal(x: Column | str, scale: int, when: Column | None = None) -> Column:
    """DECIMAL(38, max(6, scale)), half up."""
    out = max(6, scale)
    n = F.count(_gated(x, when))
    return F.try_divide(sum_decimal(x, scale, when), F.when(n != 0, n).cast("decimal(20,0)")).try_cast(f"decimal(38,{out})")


def min_(x: Column | str, when: Column | None = None) -> Column:
    return F.min(_gated(x, when))


def max_(x: Column | str, when: Column | None = None) -> Column:
    return F.max(_gated(x, when))


def count_distinct(x: Column | str, when: Column | None = None) -> Column:
    return F.count_distinct(_gated(x, when))


def sum_distinct(x: Column | str, to: str = "bigint", when: Column | None = None) -> Column:
    return wrap(F.sum_distinct(_gated(x, when).cast("decimal(20,0)")), to)


def sum_float(values: Column) -> Column:
    """Folds an ordered array of FLOATs, rounding at four bytes each step; NULL without values."""
    some = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0).cast("float"), lambda a, v: (a + v).cast("float")))
