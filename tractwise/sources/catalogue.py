"""Service areas: which tracts a library reports on, and how its map is centred."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CATALOGUE_SCHEMA = pa.schema(
    [
        ("library", pa.string()),
        ("tracts", pa.list_(pa.string())),
        ("lat", pa.float64()),
        ("lon", pa.float64()),
        ("zoom", pa.int32()),
    ]
)


def tract_list(tracts: str | Iterable[str]) -> list[str]:
    """Tracts from a list, or from text such as ``'363102','363103'``."""
    if isinstance(tracts, str):
        tracts = re.findall(r"\w+", tracts)
    return sorted({str(tract) for tract in tracts})


def _tract_array(text: Column) -> Column:
    """``tract_list`` of a text column."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\w+"), F.lit(0))
    return F.array_sort(F.array_distinct(found))


TEXT_SCHEMA = "library STRING, tracts STRING, lat DOUBLE, lon DOUBLE, zoom INT"


def _with_tracts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tracts", _tract_array(F.col("tracts")))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue CSV: ``library,tracts,lat,lon,zoom``, tracts as in ``tract_list``.

    Blanks, commas and quotes separate tracts; a cell without any is an empty list.
    """
    raw = spark.read.schema(TEXT_SCHEMA).option("header", True).option("enforceSchema", False)
    return _with_tracts(raw.csv(path))


def parse_catalogue(lines: DataFrame) -> DataFrame:
    """``read_catalogue`` of CSV lines (``value``) without a header, from any source."""
    return _with_tracts(lines.select(F.from_csv("value", TEXT_SCHEMA).alias("r")).select("r.*"))


def catalogue_of(spark: SparkSession, libraries: Iterable[tuple]) -> DataFrame:
    """Catalogue from ``(library, tracts[, lat, lon, zoom])`` tuples.

    Passed as an Arrow table, the rows become a local relation of known size, by
    which Spark decides whether to broadcast them.
    """
    rows = []
    for library, tracts, *view in libraries:
        lat, lon, zoom = view or (None, None, None)
        rows.append(
            {"library": library, "tracts": tract_list(tracts), "lat": lat, "lon": lon, "zoom": zoom}
        )
    return spark.createDataFrame(pa.Table.from_pylist(rows, CATALOGUE_SCHEMA))


def service_area_tracts(catalogue: DataFrame) -> DataFrame:
    """One row per library and tract, however often the catalogue repeats it."""
    return catalogue.select("library", F.explode("tracts").alias("tract")).distinct()


def map_views(catalogue: DataFrame) -> DataFrame:
    """Map centre and zoom per library; of several the least one that is not all NULL."""
    view = F.struct("lat", "lon", "zoom")
    given = F.coalesce("lat", "lon", "zoom").isNotNull()
    return (
        catalogue.groupBy("library")
        .agg(F.min(F.when(given, view)).alias("view"))
        .select("library", "view.lat", "view.lon", "view.zoom")
    )
