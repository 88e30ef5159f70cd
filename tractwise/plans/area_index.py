"""A stored index of patrons by area, for reports on few tracts of very large tables.

A row is a patron in a block group with everything that a report needs of the patron: number
of fields, addresses and holds, circulation figures and dates. Nothing in it depends on the
day of a report. Rows are dealt over files by ranges of tract, sorted by tract, area and
patron, and Parquet keeps the least and greatest tract of each row group and page. A report on
few tracts passes its tracts to the scan, reads the row groups that have them, and joins
nothing. Patron ids have a Bloom filter in each row group, so that the areas of one patron are
found without reading the others.

Built once, with the joins of the statistics; ``tractwise.plans.refresh`` keeps totals up to
date. The conditions of ``patron_stats`` hold (``key_violations``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tractwise.functions import codes, patrons
from tractwise.operators import areas, facts
from tractwise.plans.stats import Day, report, totals
from tractwise.sources.catalogue import tract_list
from tractwise.sources.tables import PatronTables

INDEX = (
    "tract STRING, geoid STRING, id BIGINT, fields BIGINT, addresses BIGINT, holds BIGINT,"
    " distinct_holds BIGINT, checkout_total INT, renewal_total INT, checkout_count INT,"
    " birth_date DATE, activity_date DATE, creation_date DATE, blocked BOOLEAN"
)

#: Bytes of a row group: some thousand patrons, so that a tract is a few of them.
ROW_GROUP_BYTES = 1 << 20
#: Distinct patron ids that a Bloom filter is laid out for.
BLOOM_IDS = 1 << 16


def indexed_patrons(tables: PatronTables) -> DataFrame:
    """The rows of the index."""
    coded = areas.census_fields(tables.varfield)
    located = areas.patron_areas(coded, [], "block_group")
    figures = tables.patron_record.select(
        "id",
        "checkout_total",
        "renewal_total",
        "checkout_count",
        F.to_date("birth_date_gmt").alias("birth_date"),
        F.to_date("activity_gmt").alias("activity_date"),
        patrons.is_blocked(F.col("mblock_code"), F.col("owed_amt")).alias("blocked"),
    )
    created = tables.record_metadata.select(
        "id", F.to_date("creation_date_gmt").alias("creation_date")
    )
    rows = (
        located.join(figures, "id")
        .join(facts.address_counts(tables.patron_record_address), "id")
        .join(created, "id")
        .join(facts.hold_counts(tables.hold, tables.unique_holds), "id", "left")
        .withColumn("tract", codes.tract_of(F.col("geoid")))
    )
    names = [part.split()[0] for part in INDEX.split(", ")]
    return rows.select(*names)


def build_area_index(tables: PatronTables, path: str, ranges: int | None = None) -> None:
    """Store the index in a new folder, in a given number of ranges or as many as Spark
    chooses; raises if the folder has anything."""
    key = ("tract", "geoid", "id")
    rows = indexed_patrons(tables)
    (
        (rows.repartitionByRange(ranges, *key) if ranges else rows.repartitionByRange(*key))
        .sortWithinPartitions(*key)
        .write.mode("errorifexists")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.bloom.filter.enabled#id", True)
        .option("parquet.bloom.filter.expected.ndv#id", BLOOM_IDS)
        .parquet(path)
    )


def read_area_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def areas_of_patron(index: DataFrame, patron: int) -> DataFrame:
    """tract, geoid and fields of one patron; the Bloom filters rule out most row groups."""
    return index.where(F.col("id") == F.lit(patron)).select("tract", "geoid", "fields")


def patron_rows(index: DataFrame, as_of: Day) -> DataFrame:
    """Rows of the index as the statistics sum them up on some day."""
    today = patrons.as_of_date(as_of)
    copies = F.col("fields") * F.col("addresses") * F.coalesce("holds", F.lit(1))
    return index.select(
        "geoid",
        "id",
        copies.alias("copies"),
        "checkout_total",
        "renewal_total",
        (F.col("checkout_total") + F.col("renewal_total")).alias("circ"),
        "checkout_count",
        "distinct_holds",
        patrons.age_in_years(F.col("birth_date"), today).alias("age"),
        patrons.within_last_year(F.col("creation_date"), today).alias("is_new"),
        patrons.within_last_year(F.col("activity_date"), today).alias("is_active"),
        F.col("blocked").alias("is_blocked"),
    )


def indexed_stats(
    index: DataFrame,
    tracts: str | Iterable[str] | None = None,
    as_of: Day = None,
    level: str = "block_group",
    min_patrons: int | None = None,
) -> DataFrame:
    """``patron_stats`` from an index.

    At coarser levels a patron with several block groups in one area is one row first.
    """
    if tracts is not None:
        index = index.where(F.col("tract").isin(tract_list(tracts)))
    rows = patron_rows(index, as_of).withColumn("geoid", codes.area_of(F.col("geoid"), level))
    if level != "block_group":
        same = [name for name in rows.columns if name not in ("geoid", "id", "copies")]
        rows = rows.groupBy("geoid", "id").agg(
            F.sum("copies").alias("copies"), *[F.any_value(name).alias(name) for name in same]
        )
    return report(totals(rows, []), [], codes.profile_url(F.col("geoid"), level), min_patrons)
