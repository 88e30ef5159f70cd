"""Rounding rules. The results use three, and they differ on ties."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F


def percent_text(part: Column, whole: Column) -> Column:
    """Exact percentage as text with two decimals, ties away from zero."""
    part, whole = part.cast("decimal(12,2)"), whole.cast("decimal(12,2)")
    return F.round(F.lit(Decimal("100.0")) * part / whole, 2).cast("string")


def ratio_text(total: Column, count: Column) -> Column:
    """Exact quotient as text with two decimals, ties away from zero."""
    total, count = total.cast("decimal(20,0)"), count.cast("decimal(20,0)")
    return F.round(total / count, 2).cast("string")


def whole_mean(total: Column, count: Column) -> Column:
    """Mean as a whole-valued double, ties to even; NULL for no values."""
    return F.rint(F.try_divide(total, count))


def two_decimals(value: Column) -> Column:
    """Double rounded the way NumPy does: scale, ties to even, scale back."""
    return F.rint(value * 100) / 100


def cardholder_percent(patrons: Column, population: Column) -> Column:
    """Cardholders per hundred inhabitants; NULL where nobody lives."""
    return two_decimals(F.try_divide(patrons, population) * 100.0)


def two_decimal_text(value: Column) -> Column:
    """Text of a two-decimal double without exponent: ``12.5``, ``12.0``, ``12.34``."""
    return F.regexp_replace(value.cast("decimal(20,2)").cast("string"), "0$", "")
