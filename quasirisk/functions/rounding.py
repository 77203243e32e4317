"""Rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1, splits a double into two exact halves


_LONG_RANGE = 9.0e18  # what a long holds, with room for rounding


def _representable(value: Column) -> Column:
    """NULL for NaN, infinities and values beyond a long."""
    return F.when(F.abs(value.cast("double")) < _LONG_RANGE, value)


def round_up(value: Column, precision: int) -> Column:
    """Smallest multiple of 10**precision that is not below the value; NULL for NaN."""
    value = _representable(value)
    factor = F.lit(10**precision) if precision >= 0 else F.lit(float(10.0**precision))
    return F.ceil(value / factor) * factor


def round_nearest(value: Column, precision: int) -> Column:
    """Nearest multiple of 10**precision, halves to the even multiple; NULL for NaN."""
    factor = F.lit(float(10**precision))
    value = F.when(~F.isnan(value.cast("double")), value)
    return F.rint(value / factor) * factor


def truncate(value: Column) -> Column:
    """Drop the decimals, toward zero; the result is a long, NULL for NaN."""
    return _representable(value).cast("long")


def python_round(value: Column, digits: int) -> Column:
    """Round the binary double correctly: 0.35 (stored below 0.35) gives 0.3.

    Spark's ``round``/``bround`` work on the shortest decimal text and give 0.4.  Here
    value * 10**digits is split into its double and the exact rounding error of that
    product, and the error decides apparent ties; true ties go to the even digit.
    """
    scale = float(10**digits)

    def split(x):
        big = x * _SPLITTER
        high = big - (big - x)
        return high, x - high

    def nearest(v):
        product = v * scale
        (v_high, v_low), (s_high, s_low) = split(v), split(scale)
        error = v_low * s_low - (product - v_high * s_high - v_low * s_high - v_high * s_low)
        below = F.floor(product).cast("double")
        tie = (product - below) == 0.5
        return F.when(tie & (error > 0), below + 1.0).when(tie & (error < 0), below).otherwise(F.rint(product)) / scale

    # Through a lambda, so that the argument is evaluated once however often it is used.
    return F.transform(F.array(value), nearest)[0]
