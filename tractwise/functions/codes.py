"""Column expressions over the tagged census field."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tractwise.functions import fixed


def level_length(level: str) -> int:
    """Number of leading digits that name an area at ``level``."""
    try:
        return fixed.LEVELS[level][0]
    except KeyError:
        raise ValueError(f"level must be one of {list(fixed.LEVELS)}, not {level!r}") from None


def has_census_code(field: Column) -> Column:
    """True where the field starts like a census code.

    The pattern implies the plain prefix, which is there to reach the scan.
    """
    return field.startswith(fixed.CENSUS_FIELD_START) & field.rlike(fixed.CENSUS_FIELD_PATTERN)


def clean_code(field: Column) -> Column:
    """Drop every subfield marker: ``|s25|c017|t383101|b1`` -> ``250173831011``."""
    return F.regexp_replace(field, fixed.SUBFIELD_MARKER_PATTERN, "")


def area_of(code: Column, level: str = "block_group") -> Column:
    """Area id of a cleaned code at a geography level."""
    return F.substring(code, 1, level_length(level))


def tract_of(code: Column) -> Column:
    """Six-digit tract of a cleaned code (without state and county)."""
    return F.substring(code, fixed.TRACT_START, fixed.TRACT_LENGTH)


def geoid(field: Column, level: str = "block_group") -> Column:
    """Area id of a raw field; a missing field and an empty one stay apart."""
    return (
        F.when(field.isNull(), fixed.NO_FIELD_AREA)
        .when(field == "", field)
        .otherwise(area_of(clean_code(field), level))
    )


def profile_url(area: Column, level: str = "block_group") -> Column:
    """Profile address of an area id."""
    level_length(level)
    return F.concat(F.lit(fixed.PROFILE_ADDRESS + fixed.LEVELS[level][1]), area)


def profile_url_at(area: Column, level: Column) -> Column:
    """Profile address where the level differs from row to row."""
    return F.coalesce(*[F.when(level == name, profile_url(area, name)) for name in fixed.LEVELS])


def census_url(field: Column, level: str = "block_group") -> Column:
    """Profile address of a raw field, ``na`` where there is none."""
    return F.when(field.isNull() | (field == ""), fixed.NO_FIELD_URL).otherwise(
        profile_url(area_of(clean_code(field), level), level)
    )
