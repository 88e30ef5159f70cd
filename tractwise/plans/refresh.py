"""Daily statistics from changes: stored state per patron, stored totals per area.

The state has a row a patron: its record, creation date, numbers of addresses and holds, and
its areas with the number of fields in each. The totals have additive figures of every area.
What depends on the day of the report, ages and the two "in the last year" flags, is kept as
totals by date, so that another day needs no patron: a report reads the totals alone.

A change is a row of one of the five tables with ``sign``: 1 for a row that came, -1 for one
that went, both for one that changed. A refresh looks up the state of the patrons in the
changes, works out their new state, subtracts their old share from the totals of their
areas and adds the new one. Other patrons are neither joined, counted nor shuffled.

The state is a log: a refresh appends the new rows of changed patrons, and the latest row of
a patron counts. Totals are written whole, as they are small. One pointer file, written
last, makes both valid (``sinks.versions``); a refresh that fails changes nothing.

Every version of the log has a pointer of its own, so all of them stay valid, also for
``sinks.versions.sweep``. ``compact`` writes the latest rows as one version and points all
older ones to it; what it replaced is then emptied by a sweep. Without it the log, and the
scan of each refresh, grows with the number of days.

Start, refresh and compact run one at a time. The conditions of ``patron_stats`` hold before
and after the changes, with unique holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tractwise.functions import codes, numbers, patrons
from tractwise.operators import areas, facts
from tractwise.plans.stats import SUMS, Day, report
from tractwise.sinks import versions
from tractwise.sources.schemas import TABLES
from tractwise.sources.tables import PatronTables

RECORD = (
    "checkout_total INT, renewal_total INT, checkout_count INT, birth_date DATE,"
    " activity_date DATE, blocked BOOLEAN"
)
STATE = (
    f"id BIGINT, record STRUCT<{RECORD}>, creation STRUCT<day DATE>, addresses BIGINT,"
    " holds BIGINT, distinct_holds BIGINT, places ARRAY<STRUCT<geoid STRING, fields BIGINT>>"
)
#: Sums over joined rows, how many patrons have each, and what is counted once a patron.
MEASURES = [*SUMS, *[f"known_{name}" for name in SUMS], "patrons", "held", "weight"]
TOTALS = "geoid STRING, facet STRING, day DATE, " + ", ".join(f"{m} BIGINT" for m in MEASURES)
#: The owner of the totals among the pointers; versions of the log own themselves.
OWNER = "all"


def signed_changes(before: PatronTables, after: PatronTables) -> PatronTables:
    """Changes between two copies of the tables, for sources that do not tell them."""

    def between(old: DataFrame, new: DataFrame) -> DataFrame:
        came = new.exceptAll(old).withColumn("sign", F.lit(1))
        return came.unionByName(old.exceptAll(new).withColumn("sign", F.lit(-1)))

    return replace(
        after,
        **{name: between(getattr(before, name), getattr(after, name)) for name in TABLES},
    )


def _record(patron_record: DataFrame) -> DataFrame:
    record = F.struct(
        "checkout_total",
        "renewal_total",
        "checkout_count",
        F.to_date("birth_date_gmt").alias("birth_date"),
        F.to_date("activity_gmt").alias("activity_date"),
        patrons.is_blocked(F.col("mblock_code"), F.col("owed_amt")).alias("blocked"),
    )
    return patron_record.select("id", record.alias("record"))


def _creation(record_metadata: DataFrame) -> DataFrame:
    day = F.to_date("creation_date_gmt").alias("day")
    return record_metadata.select("id", F.struct(day).alias("creation"))


def _places(varfield: DataFrame, level: str) -> DataFrame:
    return areas.patron_areas(areas.census_fields(varfield), [], level)


def patron_state(tables: PatronTables, level: str = "block_group") -> DataFrame:
    """The state of every patron that any table names."""
    places = _places(tables.varfield, level)
    parts = [
        _record(tables.patron_record),
        _creation(tables.record_metadata),
        facts.address_counts(tables.patron_record_address),
        facts.hold_counts(tables.hold, unique=True),
        places.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("geoid", "fields"))).alias("places")),
    ]
    return _joined([part.where(F.col("id").isNotNull()) for part in parts]).select(*_columns())


def _columns() -> list[Column]:
    """Columns of the state, with 0 and no places where nothing is known."""
    empty = F.array().cast("array<struct<geoid:string,fields:bigint>>")
    counts = [
        F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
        for name in ("addresses", "holds", "distinct_holds")
    ]
    return [F.col("id"), F.col("record"), F.col("creation"), *counts, F.coalesce("places", empty).alias("places")]


def _joined(parts: list[DataFrame]) -> DataFrame:
    whole, *others = parts
    for part in others:
        whole = whole.join(part, "id", "full")
    return whole


def _signed(
    frame: DataFrame, count: Callable[[DataFrame], DataFrame], keys: list[str]
) -> DataFrame:
    """Counts of the rows that came less counts of those that went."""
    came, went = (count(frame.where(F.col("sign") == sign)) for sign in (1, -1))
    names = [name for name in came.columns if name not in keys]
    went = went.select(*keys, *[(-F.col(name)).alias(name) for name in names])
    return came.unionByName(went).groupBy(*keys).agg(*[F.sum(name).alias(name) for name in names])


def _replaced(frame: DataFrame, name: str, value: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The new value of changed ids, NULL where the row went and none came."""
    came = value(frame.where(F.col("sign") == 1))
    ids = frame.select("id").distinct().withColumn(f"new_{name}", F.lit(True))
    return ids.join(came, "id", "left").withColumnRenamed(name, f"came_{name}")


def changed_state(
    state: DataFrame, changes: PatronTables, level: str = "block_group"
) -> tuple[DataFrame, DataFrame]:
    """State before and after of the patrons that occur in the changes."""
    moved = _signed(changes.varfield, lambda rows: _places(rows, level), ["id", "geoid"])
    effects = [
        _replaced(changes.patron_record, "record", _record),
        _replaced(changes.record_metadata, "creation", _creation),
        _signed(changes.patron_record_address, facts.address_counts, ["id"]),
        _signed(changes.hold, lambda rows: facts.hold_counts(rows, unique=True), ["id"]),
        moved.groupBy("id").agg(F.collect_list(F.struct("geoid", "fields")).alias("places")),
    ]
    effects = [effect.where(F.col("id").isNotNull()) for effect in effects]
    effects[2] = effects[2].withColumnRenamed("addresses", "more_addresses")
    effects[3] = effects[3].withColumnsRenamed(
        {"holds": "more_holds", "distinct_holds": "more_distinct_holds"}
    )
    effects[4] = effects[4].withColumnRenamed("places", "more_places")
    effect = _joined(effects)
    old = state.join(effect.select("id"), "id", "left_semi")

    def chosen(name: str) -> Column:
        return F.when(F.col(f"new_{name}"), F.col(f"came_{name}")).otherwise(F.col(name)).alias(name)

    def added(name: str) -> Column:
        return (F.coalesce(name, F.lit(0)) + F.coalesce(f"more_{name}", F.lit(0))).alias(name)

    none = F.array().cast("array<struct<geoid:string,fields:bigint>>")
    every = F.concat(F.coalesce("places", none), F.coalesce("more_places", none))

    def summed(geoid: Column) -> Column:
        same = F.filter(every, lambda place: place["geoid"].eqNullSafe(geoid))
        total = F.aggregate(same, F.lit(0).cast("bigint"), lambda sum, place: sum + place["fields"])
        return F.struct(geoid.alias("geoid"), total.alias("fields"))

    geoids = F.array_distinct(F.transform(every, lambda place: place["geoid"]))
    places = F.filter(F.transform(geoids, summed), lambda place: place["fields"] != 0)
    new = effect.join(old, "id", "left").select(
        "id",
        chosen("record"),
        chosen("creation"),
        added("addresses"),
        added("holds"),
        added("distinct_holds"),
        F.sort_array(places).alias("places"),
    )
    return old, new


def area_totals(state: DataFrame) -> DataFrame:
    """Additive figures of the areas of some patrons."""
    rows = (
        state.where(
            F.col("record").isNotNull() & F.col("creation").isNotNull() & (F.col("addresses") > 0)
        )
        .select("*", F.inline("places"))
        .withColumn(
            "copies", F.col("fields") * F.col("addresses") * F.greatest("holds", F.lit(1))
        )
        .select("*", "record.*")
        .withColumn("circ", F.col("checkout_total") + F.col("renewal_total"))
    )
    nothing = F.lit(None).cast("date")

    def facet(name: str, day: Column, applies: Column) -> Column:
        return F.when(applies, F.struct(F.lit(name).alias("facet"), day.alias("day")))

    facets = F.array_compact(
        F.array(
            facet("all", nothing, F.lit(True)),
            facet("blocked", nothing, F.col("blocked")),
            facet("created", F.col("creation.day"), F.col("creation.day").isNotNull()),
            facet("active", F.col("activity_date"), F.col("activity_date").isNotNull()),
            facet("born", F.col("birth_date"), F.col("birth_date").isNotNull()),
        )
    )
    whole = F.col("facet") == "all"
    figures = {
        **{name: F.sum(F.when(whole, F.col(figure) * F.col("copies"))) for name, figure in SUMS.items()},
        **{f"known_{name}": F.count_if(whole & F.col(f).isNotNull()) for name, f in SUMS.items()},
        "patrons": F.count("*"),
        "held": F.sum(F.when(whole, F.col("distinct_holds"))),
        "weight": F.sum("copies"),
    }
    return (
        rows.select("*", F.inline(facets))
        .groupBy("geoid", "facet", "day")
        .agg(*[F.coalesce(v, F.lit(0)).cast("bigint").alias(n) for n, v in figures.items()])
    )


def merged_totals(totals: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Totals after the share of some patrons has changed."""
    keys = ["geoid", "facet", "day"]
    gone = area_totals(old)
    gone = gone.select(*keys, *[(-F.col(name)).alias(name) for name in MEASURES])
    every = totals.select(*keys, *MEASURES).unionByName(gone).unionByName(area_totals(new))
    summed = every.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in MEASURES])
    return summed.where(F.col("patrons") != 0)


def totals_stats(
    totals: DataFrame, as_of: Day = None, level: str = "block_group", min_patrons: int | None = None
) -> DataFrame:
    """``patron_stats`` of all areas from totals of that level, without reading a patron."""
    today = patrons.as_of_date(as_of)
    whole = F.col("facet") == "all"
    recent = patrons.within_last_year(F.col("day"), today)
    born = F.when(F.col("facet") == "born", F.col("weight"))

    def members(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("patrons"))), F.lit(0))

    def known(name: str) -> Column:
        sums = F.sum(F.when(whole, F.col(name)))
        return F.when(F.sum(F.when(whole, F.col(f"known_{name}"))) > 0, sums).alias(name)

    ages = F.sum(born * patrons.age_in_years(F.col("day"), today))
    found = totals.groupBy("geoid").agg(
        members(whole).alias("total_patrons"),
        *[known(name) for name in SUMS],
        F.sum(F.when(whole, F.col("held"))).alias("total_holds_current"),
        numbers.whole_mean(ages, F.sum(born)).alias("avg_age"),
        members((F.col("facet") == "created") & recent).alias("total_new_patrons"),
        members((F.col("facet") == "active") & recent).alias("total_active_patrons"),
        members(F.col("facet") == "blocked").alias("total_blocked_patrons"),
    )
    return report(found, [], codes.profile_url(F.col("geoid"), level), min_patrons)


def _write(spark: SparkSession, root: str, state: DataFrame, totals: Callable[[DataFrame], DataFrame]) -> str:
    version = versions.new_version()
    path = versions.version_path(root, "patrons", version)
    state.write.mode("errorifexists").parquet(path)
    # the stored rows: totals do not work the changes out again
    rows = spark.read.schema(STATE).parquet(path)
    totals(rows).write.mode("errorifexists").parquet(versions.version_path(root, "totals", version))
    owners = {"patrons": [version], "totals": [OWNER]}
    versions.point(spark, root, version, {"patrons": None, "totals": None}, owners)
    return version


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """The latest row of every patron; a log of one version is read as it is."""
    log = [row.version for row in versions.published_versions(spark, root, "patrons")]
    schema = f"{STATE}, version STRING"
    rows = spark.read.schema(schema).option("basePath", f"{root.rstrip('/')}/patrons")
    rows = rows.parquet(*[versions.version_path(root, "patrons", version) for version in log])
    if len(log) == 1:
        return rows.drop("version")
    names = [name for name in rows.columns if name not in ("id", "version")]
    latest = F.max_by(F.struct(*names), "version").alias("row")
    return rows.groupBy("id").agg(latest).select("id", "row.*")


def read_totals(spark: SparkSession, root: str) -> DataFrame:
    """The valid totals."""
    last = versions.published_versions(spark, root, "totals")[-1].version
    return spark.read.schema(TOTALS).parquet(versions.version_path(root, "totals", last))


def compact(spark: SparkSession, root: str) -> None:
    """Write the log as one version, without patrons of whom nothing is left.

    One shuffle by patron, as reading the log takes; a run that fails changes nothing.
    Totals stay as they are.
    """
    version = versions.new_version()
    pointers = versions.valid(spark, root).where(F.col("output") == "patrons")
    # a name a refresh: those that earlier compactions took in are pointed on
    owners = [row.library for row in pointers.select("library").collect()]
    known = (
        F.col("record").isNotNull()
        | F.col("creation").isNotNull()
        | (F.col("addresses") != 0)
        | (F.col("holds") != 0)
        | (F.col("distinct_holds") != 0)
        | (F.size("places") > 0)
    )
    state = read_state(spark, root).where(known)
    state.write.mode("errorifexists").parquet(versions.version_path(root, "patrons", version))
    versions.point(spark, root, version, {"patrons": None}, owners)


def start(tables: PatronTables, root: str, level: str = "block_group") -> None:
    """Store state and totals of the tables, once."""
    spark = tables.patron_record.sparkSession
    _write(spark, root, patron_state(tables, level), area_totals)


def refresh(changes: PatronTables, root: str, level: str = "block_group") -> None:
    """Bring state and totals below ``root`` up to date."""
    spark = changes.patron_record.sparkSession
    totals, state = read_totals(spark, root), read_state(spark, root)
    old, new = changed_state(state, changes, level)
    _write(spark, root, new, lambda rows: merged_totals(totals, old, rows))
