"""Conditions under which weighted patrons equal joined rows, and gaps of a catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tractwise.functions import codes
from tractwise.operators import areas
from tractwise.sources.catalogue import service_area_tracts
from tractwise.sources.tables import PatronTables


def key_violations(tables: PatronTables) -> DataFrame:
    """Keys that break a condition of ``patron_stats``; empty for sound tables.

    Patron and metadata ids are unique, and a hold belongs to one patron (and, with
    ``unique_holds``, occurs once). Where this returns rows, use
    ``patron_stats_direct``.
    """

    def repeated(frame: DataFrame, table: str, count) -> DataFrame:
        return (
            frame.groupBy("id")
            .agg(count.alias("times"))
            .where(F.col("times") > 1)
            .select(F.lit(table).alias("table"), "id", "times")
        )

    parts = [
        repeated(tables.patron_record, "patron_record", F.count("*")),
        repeated(tables.record_metadata, "record_metadata", F.count("*")),
        repeated(
            tables.hold.where(F.col("id").isNotNull()),
            "hold",
            F.count("*") if tables.unique_holds else F.count_distinct("patron_record_id"),
        ),
    ]
    return reduce(DataFrame.unionAll, parts)


def require_keys(tables: PatronTables) -> None:
    """Raise ValueError with the number of ``key_violations`` per table, if there are any."""
    broken = key_violations(tables).groupBy("table").count().orderBy("table").collect()
    if broken:
        counts = ", ".join(f"{row['table']} {row['count']}" for row in broken)
        raise ValueError(f"keys that repeat: {counts}; see key_violations")


def catalogue_problems(catalogue: DataFrame, varfield: DataFrame) -> DataFrame:
    """What is odd about the tracts of a catalogue: problem, library, tract, fields.

    ``shared``: a tract of several libraries, whose patrons count for each of them;
    ``empty``: a tract of a library that no census field names;
    ``unserved``: a tract that fields name and no library has (library NULL).
    ``fields`` is the number of fields that name the tract. Fields are counted by tract before
    they meet the catalogue, so both sides have a row a tract, or a tract and library.
    """
    tract = codes.tract_of(F.col("code")).alias("tract")
    named = (
        areas.census_fields(varfield).select(tract).groupBy("tract").agg(F.count("*").alias("fields"))
    )
    served = service_area_tracts(catalogue)
    several = served.groupBy("tract").agg((F.count("*") > 1).alias("is_shared"))
    rows = served.join(several, "tract").join(named, "tract", "full")
    problems = F.array_compact(
        F.array(
            F.when(F.col("is_shared"), "shared"),
            F.when(F.col("is_shared").isNotNull() & F.col("fields").isNull(), "empty"),
            F.when(F.col("is_shared").isNull(), "unserved"),
        )
    )
    return rows.select(
        F.explode(problems).alias("problem"),
        "library",
        "tract",
        F.coalesce("fields", F.lit(0)).alias("fields"),
    )
