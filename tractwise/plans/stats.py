"""Area statistics: one row per area, or per library and area."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from tractwise.functions import codes, fixed, numbers, patrons
from tractwise.operators import areas, facts
from tractwise.sources.catalogue import service_area_tracts
from tractwise.sources.tables import PatronTables

Day = date | str | Column | None


def patron_stats(
    tables: PatronTables,
    tracts: str | Iterable[str] | None = None,
    as_of: Day = None,
    level: str = "block_group",
    min_patrons: int | None = None,
    store_at: str | None = None,
) -> DataFrame:
    """Statistics of the areas in ``tracts`` (all areas when left out).

    Areas with fewer than ``min_patrons`` cardholders are dropped. Sorted by
    cardholders, most first.

    For a few tracts of very large tables give ``store_at``, a path on shared storage.
    The cardholders of the tracts are stored in a new folder there and the other tables are
    reduced to them before anything is counted. Spark chooses the joins by the size of the
    files. For many such reports build an index (``tractwise.plans.area_index``).
    """
    coded = areas.census_fields(tables.varfield)
    if tracts is not None:
        coded = areas.in_tracts(coded, tracts)
    located = areas.patron_areas(coded, [], level)
    rows = _patron_rows(*_reduced(located, tables, store_at), as_of)
    return report(totals(rows, []), [], codes.profile_url(F.col("geoid"), level), min_patrons)


def library_stats(
    tables: PatronTables,
    catalogue: DataFrame,
    as_of: Day = None,
    level: str = "block_group",
    min_patrons: int | None = None,
    store_at: str | None = None,
) -> DataFrame:
    """``patron_stats`` of every library of a catalogue in one job."""
    keys = ["library"]
    coded = areas.in_service_areas(
        areas.census_fields(tables.varfield), service_area_tracts(catalogue)
    )
    located = areas.patron_areas(coded, keys, level)
    rows = _patron_rows(*_reduced(located, tables, store_at), as_of)
    return report(totals(rows, keys), keys, codes.profile_url(F.col("geoid"), level), min_patrons)


def rollup_stats(
    tables: PatronTables,
    tracts: str | Iterable[str] | None = None,
    catalogue: DataFrame | None = None,
    as_of: Day = None,
    min_patrons: int | None = None,
) -> DataFrame:
    """Statistics at every geography level at once, told apart by ``level``.

    Sums add up from level to level, distinct counts do not: a patron with two block groups in a
    county is one of its patrons. So of a patron's areas in each larger area only the first
    counts the patron for it. The joins have put all rows of a patron in one partition, so
    this takes no shuffle, and rows are not copied for a level; what is added up over levels
    has a row a block group.
    """
    if tracts is not None and catalogue is not None:
        raise ValueError("give tracts or a catalogue, not both")
    keys = [] if catalogue is None else ["library"]
    coded = areas.census_fields(tables.varfield)
    if tracts is not None:
        coded = areas.in_tracts(coded, tracts)
    if catalogue is not None:
        coded = areas.in_service_areas(coded, service_area_tracts(catalogue))
    located = areas.patron_areas(coded, keys, "block_group")
    rows = _patron_rows(located, tables, as_of)
    # a patron's areas in order: those of one county, say, are neighbours, and the first of them
    # counts the patron for the county
    before = F.lag("geoid").over(Window.partitionBy(*keys, "id").orderBy("geoid"))
    rows = rows.withColumn("before", before)

    def is_first(level: str) -> Column:
        same = codes.area_of(F.col("before"), level) == codes.area_of(F.col("geoid"), level)
        return F.col("before").isNull() | ~same

    once = {
        "total_patrons": lambda first: F.count_if(first),
        "total_new_patrons": lambda first: F.count_if(first & F.col("is_new")),
        "total_active_patrons": lambda first: F.count_if(first & F.col("is_active")),
        "total_blocked_patrons": lambda first: F.count_if(first & F.col("is_blocked")),
        "total_holds_current": lambda first: F.sum(F.when(first, F.col("distinct_holds"))),
    }
    by_area = rows.groupBy(*keys, "geoid").agg(
        *[F.sum(value).alias(name) for name, value in weighted_sums().items()],
        *[
            F.struct(*[count(is_first(level)).alias(name) for name, count in once.items()]).alias(level)
            for level in fixed.LEVELS
        ],
    )
    each_level = F.array(
        *[
            F.struct(
                F.lit(level).alias("level"),
                codes.area_of(F.col("geoid"), level).alias("area"),
                *[F.col(level)[name].alias(name) for name in once],
            )
            for level in fixed.LEVELS
        ]
    )
    keys = [*keys, "level"]
    whole = (
        by_area.select("*", F.inline(each_level))
        .groupBy(*keys, F.col("area").alias("geoid"))
        .agg(
            *[F.sum(name).alias(name) for name in SUMS],
            *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in once],
            numbers.whole_mean(F.sum("ages"), F.sum("known_ages")).alias("avg_age"),
        )
    )
    return report(whole, keys, codes.profile_url_at(F.col("geoid"), F.col("level")), min_patrons)


def patron_stats_direct(
    tables: PatronTables,
    tracts: str | Iterable[str] | None = None,
    as_of: Day = None,
    level: str = "block_group",
    min_patrons: int | None = None,
) -> DataFrame:
    """``patron_stats`` of tables whose keys may repeat, as ``key_violations`` tells.

    Rows that share a patron key are summed per table first, so each side has one row
    per patron, whatever the keys. A hold counts once per area, also under several
    patrons, so holds are paired with areas and counted in a branch of their own.
    """
    today = patrons.as_of_date(as_of)
    coded = areas.census_fields(tables.varfield)
    if tracts is not None:
        coded = areas.in_tracts(coded, tracts)
    rows = (
        areas.patron_areas(coded, [], level)
        .join(facts.summed_measures(tables.patron_record, today), "id")
        .join(facts.address_counts(tables.patron_record_address), "id")
        .join(facts.summed_creation(tables.record_metadata, today), "id")
    )
    counted = facts.hold_counts(tables.hold, unique=True).select("id", "holds")
    copies = F.col("fields") * F.col("addresses") * F.coalesce("holds", F.lit(1))

    def weighted(name: str, other: str) -> Column:
        return F.sum(F.col(name) * F.col(other) * copies)

    whole = (
        rows.join(counted, "id", "left")
        .groupBy("geoid")
        .agg(
            F.count("*").alias("total_patrons"),
            weighted("checkout_total", "creations").alias("total_checkouts"),
            weighted("renewal_total", "creations").alias("total_renewals"),
            weighted("circ", "creations").alias("total_circ"),
            weighted("checkout_count", "creations").alias("total_checkouts_current"),
            numbers.whole_mean(
                weighted("age", "creations"), weighted("known_ages", "creations")
            ).alias("avg_age"),
            F.count_if("is_new").alias("total_new_patrons"),
            F.count_if("is_active").alias("total_active_patrons"),
            F.count_if("is_blocked").alias("total_blocked_patrons"),
        )
    )
    # the few patrons with very many holds are dealt over parts, all others are copied once
    frequent = F.broadcast(facts.frequent_patrons(tables.hold))
    last = F.coalesce("parts", F.lit(1)) - 1
    held = (
        rows.select("geoid", "id")
        .join(frequent, "id", "left")
        .select("geoid", "id", F.explode(F.sequence(F.lit(0), last)).alias("part"))
        .join(facts.hold_parts(tables.hold, frequent), ["id", "part"])
        .select("geoid", "hold_id")
        .distinct()
        .groupBy("geoid")
        .agg(F.count("*").alias("total_holds_current"))
    )
    whole = whole.join(held, "geoid", "left").na.fill(0, ["total_holds_current"])
    return report(whole, [], codes.profile_url(F.col("geoid"), level), min_patrons)


def _reduced(
    patron_areas: DataFrame, tables: PatronTables, store_at: str | None
) -> tuple[DataFrame, PatronTables]:
    """Patron areas; if they are stored, reread, with the tables cut down to their patrons."""
    if store_at is None:
        return patron_areas, tables
    path = f"{store_at.rstrip('/')}/patrons-{uuid.uuid4().hex}"
    patron_areas.write.mode("errorifexists").parquet(path)
    stored = patron_areas.sparkSession.read.schema(patron_areas.schema).parquet(path)
    return stored, tables.of_patrons(stored)


def _patron_rows(patron_areas: DataFrame, tables: PatronTables, as_of: Day) -> DataFrame:
    """Patron areas with the patron's figures, and ``copies``, the number of
    joined rows each stands for.

    The areas come first, as they are the only selective side. Every side has the
    patron key as its partitioning, so each is shuffled once and the chain of
    joins adds no shuffle.
    """
    today = patrons.as_of_date(as_of)
    joined = (
        patron_areas.join(facts.patron_measures(tables.patron_record, today), "id")
        .join(facts.address_counts(tables.patron_record_address), "id")
        .join(facts.patron_creation(tables.record_metadata, today), "id")
        .join(facts.hold_counts(tables.hold, tables.unique_holds), "id", "left")
    )
    factors = ("fields", "addresses", "holds")
    copies = F.col("fields") * F.col("addresses") * F.coalesce("holds", F.lit(1))
    return joined.select(
        *[name for name in joined.columns if name not in factors], copies.alias("copies")
    )


#: Sums over the joined rows and what they sum.
SUMS = {
    "total_checkouts": "checkout_total",
    "total_renewals": "renewal_total",
    "total_circ": "circ",
    "total_checkouts_current": "checkout_count",
}


def weighted_sums() -> dict[str, Column]:
    """Figures of a patron as the joined rows repeat them, to be summed over patrons."""
    copies = F.col("copies")
    return {
        **{name: F.col(figure) * copies for name, figure in SUMS.items()},
        "ages": F.col("age") * copies,
        "known_ages": F.when(F.col("age").isNotNull(), copies),
    }


def totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregate rows that are unique per patron and area."""
    sums = {name: F.sum(value) for name, value in weighted_sums().items()}
    return rows.groupBy(*keys, "geoid").agg(
        F.count("*").alias("total_patrons"),
        *[sums[name].alias(name) for name in SUMS],
        F.coalesce(F.sum("distinct_holds"), F.lit(0)).alias("total_holds_current"),
        numbers.whole_mean(sums["ages"], sums["known_ages"]).alias("avg_age"),
        F.count_if("is_new").alias("total_new_patrons"),
        F.count_if("is_active").alias("total_active_patrons"),
        F.count_if("is_blocked").alias("total_blocked_patrons"),
    )


def report(
    whole: DataFrame, keys: list[str], url: Column, min_patrons: int | None
) -> DataFrame:
    """Totals with rates and profile address, in declared column order.

    Areas with most patrons come first, ties by area id.
    """
    patron_count = F.col("total_patrons")
    derived = {
        "pct_active": numbers.percent_text(F.col("total_active_patrons"), patron_count),
        "pct_blocked": numbers.percent_text(F.col("total_blocked_patrons"), patron_count),
        "checkouts_per_patron": numbers.ratio_text(F.col("total_checkouts"), patron_count),
        "census_reporter_url": url,
    }
    if min_patrons is not None:
        whole = whole.where(patron_count >= min_patrons)
    columns = [derived.get(name, F.col(name)).alias(name) for name in fixed.STAT_COLUMNS]
    return whole.select(*keys, *columns).orderBy(*keys, F.desc("total_patrons"), "geoid")
