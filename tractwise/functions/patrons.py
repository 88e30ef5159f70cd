"""Column expressions over patron fields; ``as_of`` stands for "today"."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

from tractwise.functions import fixed


def as_of_date(as_of: date | str | Column | None = None) -> Column:
    """The reporting date as a column; the current date by default."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return F.to_date(as_of)
    return F.lit(as_of).cast("date")


def age_in_years(birth: Column, as_of: Column) -> Column:
    """Completed calendar years; someone born on 29 February ages on 1 March.

    Calendar fields only, so no time zone matters. Of a birth to come, years left.
    """
    born = F.to_date(birth)
    months = 12 * (F.year(as_of) - F.year(born)) + F.month(as_of) - F.month(born)
    days = F.day(as_of) - F.day(born)
    full = (
        F.when((months > 0) & (days < 0), months - 1)
        .when((months < 0) & (days > 0), months + 1)
        .otherwise(months)
    )
    return (full / 12).cast("int")


def within_last_year(moment: Column, as_of: Column) -> Column:
    """The date part lies in the year before ``as_of``, first day included."""
    return F.to_date(moment) >= F.add_months(as_of, -12)


def is_blocked(block_code: Column, owed: Column) -> Column:
    """Blocked by code or by debt. NULL when neither side is known to be true."""
    return (block_code != fixed.NOT_BLOCKED_CODE) | (owed >= fixed.BLOCKING_DEBT)
