"""Hover labels as string expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F

from tractwise.functions import numbers


def number_text(name: str) -> Column:
    """Text of a layer column; only the cardholder percentage is a double."""
    if name == "pct_cardholders":
        return numbers.two_decimal_text(F.col(name))
    return F.col(name).cast("string")


def render(template: str) -> Column:
    """Fill a label template from columns. NULL where any of them is NULL."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(number_text(name))
    return F.concat(*parts)
