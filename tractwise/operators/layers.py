"""Map layers: area statistics with population, boundary and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tractwise.functions import fixed, numbers
from tractwise.functions.labels import number_text, render
from tractwise.sources.catalogue import map_views
from tractwise.sources.files import lower_names


def _keys(layer: DataFrame) -> list[str]:
    """Columns that identify a feature; single-library layers have no library."""
    return [name for name in ("library", "geoid") if name in layer.columns]


def _beside(right: DataFrame, taken: list[str], suffix: str) -> DataFrame:
    """``right`` to be joined by ``geoid``; its columns of ``taken`` names get a suffix."""
    lower = {name.lower() for name in taken} - {"geoid"}
    return right.toDF(
        *[f"{name}_{suffix}" if name.lower() in lower else name for name in right.columns]
    )


def with_population(stats: DataFrame, population: DataFrame) -> DataFrame:
    """Areas that have a population row, with the cardholder percentage.

    Where both sides have a column, the population's is named ``<name>_population``.
    """
    population = _beside(population, [*stats.columns, "pct_cardholders"], "population")
    return stats.join(population, "geoid").withColumn(
        "pct_cardholders",
        numbers.cardholder_percent(F.col("total_patrons"), F.col("estimated_population")),
    )


def map_layer(stats: DataFrame, boundary: DataFrame, population: DataFrame) -> DataFrame:
    """Areas that have a boundary and a population row, under lower-case names.

    The wide boundary text joins last and passes through no aggregate. Where both sides
    have a column, the boundary's is named ``<name>_boundary``.
    """
    valued = with_population(stats, population)
    return valued.join(_beside(lower_names(boundary), valued.columns, "boundary"), "geoid")


def unmatched_areas(stats: DataFrame, boundary: DataFrame, population: DataFrame) -> DataFrame:
    """Areas that the inner joins of ``map_layer`` leave out, and what they lack."""
    has_boundary = lower_names(boundary).select("geoid").distinct()
    has_population = population.select("geoid").distinct()
    return (
        stats.select(*_keys(stats), "total_patrons")
        .join(has_boundary.withColumn("has_boundary", F.lit(True)), "geoid", "left")
        .join(has_population.withColumn("has_population", F.lit(True)), "geoid", "left")
        .withColumn("has_boundary", F.coalesce("has_boundary", F.lit(False)))
        .withColumn("has_population", F.coalesce("has_population", F.lit(False)))
        .where(~(F.col("has_boundary") & F.col("has_population")))
    )


def with_view(layer: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add map centre and zoom of the library; NULL where the catalogue has none."""
    return layer.join(map_views(catalogue), "library", "left")


def cardholder_layer(layer: DataFrame) -> DataFrame:
    """One value per feature: the cardholder percentage."""
    return layer.select(
        *_keys(layer),
        F.lit(fixed.CARDHOLDER_TITLE).alias("title"),
        F.col("pct_cardholders").alias("value"),
        render(fixed.CARDHOLDER_LABEL).alias("label"),
    )


def dual_layer(layer: DataFrame) -> DataFrame:
    """Two values per feature: cardholder percentage (1) and active percentage (2)."""

    def pane(order: int, title: str, metric: str, template: str):
        return F.struct(
            F.lit(order).alias("pane"),
            F.lit(title).alias("title"),
            F.lit(metric).alias("metric"),
            F.col(metric).cast("double").alias("value"),
            render(template).alias("label"),
        )

    panes = F.array(
        pane(1, fixed.CARDHOLDER_TITLE, "pct_cardholders", fixed.DUAL_CARDHOLDER_LABEL),
        pane(2, fixed.ACTIVE_TITLE, "pct_active", fixed.DUAL_ACTIVE_LABEL),
    )
    return layer.select(*_keys(layer), F.inline(panes))


def metric_long(layer: DataFrame) -> DataFrame:
    """Ten rows per feature, one for each metric of the menu."""
    keys = [*_keys(layer), "geographic_area_name"]
    texts = layer.select(*keys, *[number_text(name).alias(name) for name in fixed.METRICS])
    order = F.array_position(F.array(*[F.lit(name) for name in fixed.METRICS]), F.col("metric"))
    return (
        texts.unpivot(keys, fixed.METRICS, "metric", "value_text")
        .withColumn("metric_order", order.cast("int"))
        .withColumn("is_default", F.col("metric") == fixed.METRICS[0])
        .withColumn("value", F.col("value_text").cast("double"))
        .withColumn("label", render(fixed.METRIC_LABEL))
    )


def geojson_features(layer: DataFrame) -> DataFrame:
    """One GeoJSON feature text per row; NULL properties are kept.

    The geometry is text already and is put in unparsed.
    """
    names = [name for name in layer.columns if name not in ("library", "geometry_json")]
    properties = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    # the id as JSON text: what to_json makes of {"id":...} without its braces
    owner = F.to_json(F.struct(F.col("geoid").alias("id")), {"ignoreNullFields": "false"})
    feature = F.concat(
        F.lit('{"type":"Feature",'),
        F.substring(owner, F.lit(2), F.length(owner) - 2),
        F.lit(',"properties":'),
        properties,
        F.lit(',"geometry":'),
        F.coalesce("geometry_json", F.lit("null")),
        F.lit("}"),
    )
    return layer.select(*_keys(layer), feature.alias("feature"))


def collection_lines(features: DataFrame) -> DataFrame:
    """Lines that make one GeoJSON collection of each library: library, place, key, value.

    In order of place and key the lines are a head, the features with a comma before all but
    the first, and a tail. Features that are equal are one line, written as often as they
    occur, so that a line is known by its text and the first one needs no numbering.
    """
    lines = features.groupBy("library", "geoid", "feature").agg(F.count("*").alias("times"))
    first = features.groupBy("library").agg(
        F.min(F.struct("geoid", "feature")).alias("first"), F.lit(True).alias("one")
    )
    repeated = F.array_join(F.expr("array_repeat(feature, CAST(times AS INT))"), ",")
    is_first = F.struct("geoid", "feature").eqNullSafe(F.col("first"))
    body = lines.join(first, "library").select(
        "library",
        F.lit(1).alias("place"),
        F.concat_ws(" ", "geoid", "feature").alias("key"),
        F.concat(F.when(is_first, "").otherwise(","), repeated).alias("value"),
    )

    def alone(place: int, text: str) -> DataFrame:
        return first.select(
            "library", F.lit(place).alias("place"), F.lit("").alias("key"), F.lit(text).alias("value")
        )

    head = alone(0, '{"type":"FeatureCollection","features":[')
    return head.unionByName(body).unionByName(alone(2, "]}"))
