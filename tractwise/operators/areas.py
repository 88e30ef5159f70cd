"""Census fields, and the areas that patrons belong to."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tractwise.functions import codes, fixed
from tractwise.sources.catalogue import tract_list


def census_fields(varfield: DataFrame) -> DataFrame:
    """Cleaned code of every field that holds one: ``id``, ``code``."""
    return varfield.where(
        (F.col("varfield_type_code") == fixed.CENSUS_FIELD_TYPE)
        & codes.has_census_code(F.col("field_content"))
    ).select(F.col("record_id").alias("id"), codes.clean_code(F.col("field_content")).alias("code"))


def in_tracts(coded: DataFrame, tracts: str | Iterable[str]) -> DataFrame:
    """Keep codes in the given tracts, in whatever county they are."""
    return coded.where(codes.tract_of(F.col("code")).isin(tract_list(tracts)))


def in_service_areas(coded: DataFrame, service_area: DataFrame) -> DataFrame:
    """Add the library; a code appears once per library that serves its tract.

    No side is forced to be broadcast. A catalogue file is small enough for Spark
    to do so by its size; one that is not is joined by tract with skew splitting.

    A code is never NULL. Saying so keeps Spark from adding a null check that would
    clean every field a second time.
    """
    tract = F.coalesce(codes.tract_of(F.col("code")), F.lit(""))
    return coded.withColumn("tract", tract).join(service_area, "tract")


def patron_areas(coded: DataFrame, keys: list[str], level: str) -> DataFrame:
    """One row per patron and area, with the number of fields that name it.

    Fields are counted before they are gathered by patron, which bounds a patron
    with very many fields by the number of areas.
    """
    area = codes.area_of(F.col("code"), level).alias("geoid")
    return (
        coded.select(*keys, area, "id")
        .groupBy(*keys, "geoid", "id")
        .agg(F.count("*").alias("fields"))
    )
