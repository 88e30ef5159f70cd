"""Whole jobs: from patron tables to the stored layers of every library."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from tractwise.operators import layers
from tractwise.operators.checks import require_keys
from tractwise.plans.stats import library_stats
from tractwise.sinks import versions
from tractwise.sources.tables import PatronTables

LAYERS = ("cardholder", "dual", "metrics", "features")
#: Outputs that keep a version per day.
DATED = ("stats", "dual", "metrics")


def library_names(catalogue: DataFrame) -> list[str]:
    """Libraries of a catalogue; a catalogue is as small as the number of libraries."""
    return [row.library for row in catalogue.select("library").distinct().collect() if row.library]


def _written_stats(
    tables: PatronTables,
    catalogue: DataFrame,
    root: str,
    version: str,
    run_date: date,
    min_patrons: int | None,
) -> DataFrame:
    """The statistics of all libraries, written as a version and reread from it."""
    stats = library_stats(tables, catalogue, as_of=run_date, min_patrons=min_patrons)
    versions.write_version(stats, root, "stats", version)
    reader = stats.sparkSession.read.schema(stats.schema)
    # without the folder names
    return reader.parquet(versions.version_path(root, "stats", version)).select(*stats.columns)


def store_stats(
    tables: PatronTables,
    catalogue: DataFrame,
    root: str,
    run_date: date,
    min_patrons: int | None = None,
) -> DataFrame:
    """Compute the statistics of all libraries once, publish and reread them.

    Layers built on the returned table read a few rows per area, and none of them
    runs the report again when it is written or when executors are lost.
    """
    version, spark = versions.new_version(), catalogue.sparkSession
    stats = _written_stats(tables, catalogue, root, version, run_date, min_patrons)
    versions.point(spark, root, version, {"stats": run_date}, library_names(catalogue))
    versions.sweep(spark, root)
    return stats


def publish(
    tables: PatronTables,
    catalogue: DataFrame,
    boundary: DataFrame,
    population: DataFrame,
    root: str,
    run_date: date,
    outputs: tuple[str, ...] = LAYERS,
    min_patrons: int | None = None,
    check_keys: bool = False,
) -> None:
    """Store statistics and layers of every library under ``root``.

    ``stats``, ``dual`` and ``metrics`` keep one version per day, ``cardholder``
    and ``features`` the latest one; ``read_published`` reads them. All outputs change
    together when everything is written: a run that fails leaves every output as it
    was. ``root`` must be shared storage. With ``check_keys`` nothing is written, and
    ValueError raised, if a key repeats that the statistics take for unique.
    """
    unknown = set(outputs) - set(LAYERS)
    if unknown:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    if check_keys:
        require_keys(tables)
    spark, version = catalogue.sparkSession, versions.new_version()
    stats = _written_stats(tables, catalogue, root, version, run_date, min_patrons)
    # as in map_layer, a boundary that occurs twice makes two rows
    valued = layers.with_population(stats, population).join(
        layers.lower_names(boundary).select("geoid"), "geoid"
    )
    if "cardholder" in outputs:
        single = layers.with_view(layers.cardholder_layer(valued), catalogue)
        versions.write_version(single, root, "cardholder", version)
    if "dual" in outputs:
        dual = layers.with_view(layers.dual_layer(valued), catalogue)
        versions.write_version(dual, root, "dual", version)
    if "metrics" in outputs:
        versions.write_version(layers.metric_long(valued), root, "metrics", version)
    if "features" in outputs:
        features = layers.geojson_features(layers.map_layer(stats, boundary, population))
        lines = features.select("library", F.col("feature").alias("value"))
        versions.write_version(lines, root, "features", version, "text")
    days = {output: run_date if output in DATED else None for output in ("stats", *outputs)}
    versions.point(spark, root, version, days, library_names(catalogue))
    versions.sweep(spark, root)
