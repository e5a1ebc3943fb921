"""Sums, averages and month keys that give the same result in every run."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOW_BITS = 20


def exact_total(df: DataFrame, amount: str, money_scale: int | None) -> Column:
    """Sum of a money column of `df`.

    A sum of doubles depends on the order in which tasks finish. With `money_scale` the
    values are added as whole numbers of their last place, which does not. A value that is
    no such number (more places, NaN, infinite, beyond BIGINT) stops the query: it needs a
    larger scale, or None for `sum_in_any_order`, which takes any double and looks at the
    column first.

    The whole numbers are added as BIGINT, several times faster than as decimals, and in
    two parts, so that the sum of the low bits and the sum of the rest both stay far
    from overflow however many rows there are.
    """
    value = F.col(amount)
    floating = isinstance(df.schema[amount].dataType, (T.DoubleType, T.FloatType))
    if not floating:
        return F.sum(value)
    if money_scale is None:
        return sum_in_any_order(df, amount)
    scale = float(10**money_scale)
    whole = F.rint(value.cast("double") * F.lit(scale))
    # Dividing gives the double nearest to the decimal number, which is what was stored.
    same = (whole / F.lit(scale)).cast(df.schema[amount].dataType) == value
    fits = ~F.isnan(value) & (F.abs(whole) < F.lit(2.0**63)) & same
    message = f"{amount} does not fit {money_scale} decimal places: "
    units = F.when(value.isNull() | fits, whole.cast("bigint")).otherwise(
        F.raise_error(F.concat(F.lit(message), value.cast("string"))).cast("bigint")
    )
    high = F.sum(F.shiftright(units, _LOW_BITS)).cast("decimal(20,0)")
    low = F.sum(units.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).cast("decimal(20,0)")
    total = high * F.lit(Decimal(1 << _LOW_BITS)) + low
    return (total * F.lit(Decimal(1).scaleb(-money_scale))).cast(f"decimal(28,{money_scale})")


def sum_in_any_order(df: DataFrame, amount: str) -> Column:
    """Sum of doubles that has the same bits however the rows are ordered and partitioned.

    The binary digits of the values are cut, at fixed places, into pieces of 20 bits; the pieces
    of a place are added as BIGINT, exactly for up to 2 ** 43 rows, and the sums put together
    from the highest place down. What cancels does so exactly: 1e16, 1 and -1e16 make 1.
    NaN, or infinity of both signs, makes NaN, as in a plain sum; of NULL alone the sum is NULL.
    The largest and the smallest value are read first, as they say how many places are needed:
    five or so for sums of money.
    """
    value = F.col(amount).cast("double")
    size = F.abs(value)
    finite = ~F.isnan(value) & (size < F.lit(math.inf))
    seen = df.where(finite & (size > 0)).agg(F.max(size), F.min(size)).first()
    places = range(0)
    if seen[0] is not None:
        lowest = max(math.frexp(seen[1])[1] - 53, -1074)
        places = range(lowest // _PIECE, (math.frexp(seen[0])[1] - 1) // _PIECE + 1)
    total = F.sum(F.when(finite, 0.0))
    for place in reversed(places):
        shifted = _times_two_to(size, -_PIECE * place)
        units = F.when(finite, F.signum(value) * _whole_piece(shifted)).cast("bigint")
        total = total + _times_two_to(F.sum(units).cast("double"), _PIECE * place)
    # Infinite values and NaN add up to what they make of any sum.
    rest = F.sum(F.when(~finite, value))
    return F.when(rest.isNotNull(), rest).otherwise(total)


_PIECE = 20


def _whole_piece(shifted: Column) -> Column:
    """The lowest 20 bits ahead of the point of a double that is not negative."""
    # Rounding down keeps doubles, beyond BIGINT too: what has no digits after the point stays.
    whole = F.when(shifted < 2.0**53, F.floor(shifted).cast("double")).otherwise(shifted)
    high = whole * 2.0**-_PIECE
    above = F.when(high < 2.0**53, F.floor(high).cast("double")).otherwise(high)
    # A double this large has no digits there, or was shifted beyond what a double holds.
    return F.when(shifted < 2.0 ** (53 + _PIECE), whole - above * 2.0**_PIECE).otherwise(0.0)


def _times_two_to(value: Column, power: int) -> Column:
    """Exact, also where the power alone is no double."""
    half = power // 2
    return value * F.lit(2.0**half) * F.lit(2.0 ** (power - half))


def mean_of(total: Column, values: Column) -> Column:
    """Average from a total and the number of non-NULL values; NULL when there are none."""
    return total.cast("double") / F.nullif(values, F.lit(0))


def month_start(date: str) -> Column:
    """First day of the month: groups like the year-month text, but as a 4-byte key.

    The cast to DATE comes first so that a timestamp without zone is not moved by the
    session's time zone.
    """
    return F.trunc(F.col(date).cast("date"), "MM")


def month_label(month: str) -> Column:
    return F.date_format(month, "yyyy-MM")
