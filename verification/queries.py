"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

import tractwise
from tractwise.functions import codes, fixed, patrons
from tractwise.functions.labels import render
from tractwise.operators import areas, checks, facts, layers
from tractwise.plans import area_index, jobs, refresh
from tractwise.sinks import versions, writers
from tractwise.sources import files
from tractwise.sources.catalogue import map_views, parse_catalogue, service_area_tracts
from tractwise.sources.files import lower_names
from tractwise.sources.schemas import TABLES
from verification import scratch, views
from verification.views import AS_OF, ASIA_TRACTS

MIN_PATRONS = 15
Query = Callable[[SparkSession, str], DataFrame]


# Sources

def population_scan(spark, sf_dir):
    return views.view(spark, sf_dir, "population")


def boundary_scan(spark, sf_dir):
    return lower_names(views.view(spark, sf_dir, "boundary"))


def service_area(spark, sf_dir):
    return service_area_tracts(views.catalogue(spark, sf_dir, "customer_tracts"))


def service_area_views(spark, sf_dir):
    return map_views(views.catalogue(spark, sf_dir, "customer_tracts"))


def population_lines(spark, sf_dir):
    lines = views.view(spark, sf_dir, "population_lines")
    return tractwise.parse_population(lines, views.POPULATION_HEADER)


def boundary_lines(spark, sf_dir):
    lines = views.view(spark, sf_dir, "boundary_lines")
    return tractwise.parse_boundary_features(lines, "GEOID STRING, NAMELSAD STRING, ALAND BIGINT")


def catalogue_lines(spark, sf_dir):
    parsed = parse_catalogue(views.view(spark, sf_dir, "catalogue_lines"))
    return parsed.select("library", F.explode("tracts").alias("tract"), "lat", "lon", "zoom")


def catalogue_problems(spark, sf_dir):
    """The catalogue of the nations and that of the customers' tracts, some of them moved."""
    moved = F.when(F.col("tract") == "381300", "381100").when(F.col("tract") == "381600", "999999")
    served = views.view(spark, sf_dir, "service_area").withColumn(
        "tract", F.coalesce(moved, F.col("tract"))
    )
    served = served.where(F.col("tract") != "382000")
    grouped = served.groupBy("library").agg(F.collect_list("tract").alias("tracts"))
    return checks.catalogue_problems(grouped, views.view(spark, sf_dir, "varfield"))


def _split_population(spark, sf_dir):
    lines = views.view(spark, sf_dir, "faulty_population_lines")
    return files.split_population(lines, views.POPULATION_HEADER)


def population_kept(spark, sf_dir):
    return _split_population(spark, sf_dir)[0]


def population_rejected(spark, sf_dir):
    return _split_population(spark, sf_dir)[1]


def _split_boundary(spark, sf_dir):
    lines = views.view(spark, sf_dir, "faulty_boundary_lines")
    return files.split_boundary_features(lines, "GEOID STRING, NAMELSAD STRING, ALAND BIGINT")


def boundary_kept(spark, sf_dir):
    return _split_boundary(spark, sf_dir)[0]


def boundary_rejected(spark, sf_dir):
    return _split_boundary(spark, sf_dir)[1]


def key_violations(spark, sf_dir):
    return tractwise.key_violations(views.tables(spark, sf_dir, repeated=True))


# Projections and filters

def _patron_fields(spark, sf_dir):
    patron = views.view(spark, sf_dir, "patron_record").select("id")
    field = views.view(spark, sf_dir, "varfield")
    return patron.join(field, patron.id == field.record_id, "left")


def census_code_clean(spark, sf_dir):
    field = F.col("field_content")
    return views.view(spark, sf_dir, "varfield").select(
        "record_id", "field_content", codes.clean_code(field).alias("code")
    )


def tract_code(spark, sf_dir):
    code = codes.clean_code(F.col("field_content"))
    return views.view(spark, sf_dir, "varfield").select(
        "record_id", codes.tract_of(code).alias("tract")
    )


def geoid_case(spark, sf_dir):
    field = F.col("field_content")
    return _patron_fields(spark, sf_dir).select("id", codes.geoid(field).alias("geoid"))


def census_url(spark, sf_dir):
    field = F.col("field_content")
    return _patron_fields(spark, sf_dir).select("id", codes.census_url(field).alias("url"))


def census_field_match(spark, sf_dir):
    field = F.col("field_content")
    return views.view(spark, sf_dir, "varfield").select(
        "record_id", "field_content", codes.has_census_code(field).alias("is_match")
    )


def tract_filter(spark, sf_dir):
    coded = areas.census_fields(views.view(spark, sf_dir, "varfield"))
    return areas.in_tracts(coded, ASIA_TRACTS)


def tract_join(spark, sf_dir):
    coded = areas.census_fields(views.view(spark, sf_dir, "varfield"))
    served = service_area_tracts(views.catalogue(spark, sf_dir))
    return areas.in_service_areas(coded, served)


def patron_age(spark, sf_dir):
    age = patrons.age_in_years(F.col("birth_date_gmt"), patrons.as_of_date(AS_OF))
    return views.view(spark, sf_dir, "patron_record").select("id", age.alias("age"))


def patron_measures(spark, sf_dir):
    record = views.view(spark, sf_dir, "patron_record")
    return facts.patron_measures(record, patrons.as_of_date(AS_OF))


def patron_creation(spark, sf_dir):
    metadata = views.view(spark, sf_dir, "record_metadata")
    return facts.patron_creation(metadata, patrons.as_of_date(AS_OF))


def mailing_addresses(spark, sf_dir):
    return facts.mailing_addresses(views.view(spark, sf_dir, "patron_record_address"))


def patron_holds(spark, sf_dir):
    patron = views.view(spark, sf_dir, "patron_record").select("id")
    counts = facts.hold_counts(views.view(spark, sf_dir, "hold"))
    return patron.join(counts, "id", "left").na.fill(0, ["holds", "distinct_holds"])


def patron_areas(spark, sf_dir):
    coded = areas.census_fields(views.view(spark, sf_dir, "varfield"))
    return areas.patron_areas(coded, [], "block_group")


# Statistics

def patron_stats(spark, sf_dir):
    return tractwise.patron_stats(views.tables(spark, sf_dir), ASIA_TRACTS, AS_OF)


def patron_stats_distinct_holds(spark, sf_dir):
    tables = replace(views.tables(spark, sf_dir), unique_holds=False)
    return tractwise.patron_stats(tables, ASIA_TRACTS, AS_OF)


def patron_stats_direct(spark, sf_dir):
    return tractwise.patron_stats_direct(views.tables(spark, sf_dir), ASIA_TRACTS, AS_OF)


def patron_stats_repeated_keys(spark, sf_dir):
    return tractwise.patron_stats_direct(views.tables(spark, sf_dir, repeated=True), as_of=AS_OF)


def patron_stats_stored(spark, sf_dir):
    path = scratch.folder(spark, "patrons")
    return tractwise.patron_stats(views.tables(spark, sf_dir), ASIA_TRACTS, AS_OF, store_at=path)


def _index(spark, sf_dir):
    path = f"{scratch.folder(spark, 'index')}/patrons"
    area_index.build_area_index(views.tables(spark, sf_dir), path)
    return area_index.read_area_index(spark, path)


def patron_stats_indexed(spark, sf_dir):
    return area_index.indexed_stats(_index(spark, sf_dir), ASIA_TRACTS, AS_OF)


def patron_stats_indexed_tract(spark, sf_dir):
    return area_index.indexed_stats(_index(spark, sf_dir), ASIA_TRACTS, AS_OF, "tract")


def patron_refresh(spark, sf_dir):
    """State of an earlier day, brought up to date by the changes since."""
    root = scratch.folder(spark, "state")
    before, after = (views.tables(spark, sf_dir, earlier=earlier) for earlier in (True, False))
    refresh.start(before, root)
    refresh.refresh(refresh.signed_changes(before, after), root)
    return refresh.totals_stats(refresh.read_totals(spark, root), AS_OF)


def patron_refresh_compacted(spark, sf_dir):
    """Changes in two runs, with the log compacted and swept after the first."""
    root = scratch.folder(spark, "state")
    before, after = (views.tables(spark, sf_dir, earlier=earlier) for earlier in (True, False))
    changes = refresh.signed_changes(before, after)

    def half(even):
        return replace(
            changes,
            **{
                name: getattr(changes, name).where((F.col(key) % 2 == 0) == even)
                for name, (_, key) in TABLES.items()
            },
        )

    refresh.start(before, root)
    refresh.refresh(half(True), root)
    refresh.compact(spark, root)
    versions.sweep(spark, root)
    refresh.refresh(half(False), root)
    return refresh.totals_stats(refresh.read_totals(spark, root), AS_OF)


def stats_at(level: str) -> Query:
    def query(spark, sf_dir):
        return tractwise.patron_stats(views.tables(spark, sf_dir), as_of=AS_OF, level=level)

    return query


def stats_min_patrons(spark, sf_dir):
    return tractwise.library_stats(
        views.tables(spark, sf_dir),
        views.catalogue(spark, sf_dir),
        AS_OF,
        min_patrons=MIN_PATRONS,
    )


def library_stats(spark, sf_dir):
    return tractwise.library_stats(
        views.tables(spark, sf_dir), views.catalogue(spark, sf_dir), AS_OF
    )


def patron_rollup(spark, sf_dir):
    return tractwise.rollup_stats(views.tables(spark, sf_dir), as_of=AS_OF)


def library_rollup(spark, sf_dir):
    return tractwise.rollup_stats(
        views.tables(spark, sf_dir), catalogue=views.catalogue(spark, sf_dir), as_of=AS_OF
    )


# Layers

def _valued(spark, sf_dir):
    return layers.with_population(library_stats(spark, sf_dir), population_scan(spark, sf_dir))


def map_layer(spark, sf_dir):
    return tractwise.map_layer(
        library_stats(spark, sf_dir),
        views.view(spark, sf_dir, "boundary"),
        population_scan(spark, sf_dir),
    )


def pct_cardholders(spark, sf_dir):
    return _valued(spark, sf_dir).select("library", "geoid", "pct_cardholders")


def label_cardholder(spark, sf_dir):
    return _valued(spark, sf_dir).select(
        "library", "geoid", render(fixed.CARDHOLDER_LABEL).alias("label")
    )


def label_dual(spark, sf_dir):
    return _valued(spark, sf_dir).select(
        "library",
        "geoid",
        render(fixed.DUAL_CARDHOLDER_LABEL).alias("cardholder_label"),
        render(fixed.DUAL_ACTIVE_LABEL).alias("active_label"),
    )


def label_metric(spark, sf_dir):
    return metric_long(spark, sf_dir).select("library", "geoid", "metric", "label")


def cardholder_layer(spark, sf_dir):
    return tractwise.with_view(
        tractwise.cardholder_layer(map_layer(spark, sf_dir)), views.catalogue(spark, sf_dir)
    )


def dual_layer(spark, sf_dir):
    return tractwise.with_view(
        tractwise.dual_layer(map_layer(spark, sf_dir)), views.catalogue(spark, sf_dir)
    )


def metric_long(spark, sf_dir):
    return tractwise.metric_long(map_layer(spark, sf_dir))


def geojson_features(spark, sf_dir):
    return tractwise.geojson_features(map_layer(spark, sf_dir))


def unmatched_areas(spark, sf_dir):
    return tractwise.unmatched_areas(
        library_stats(spark, sf_dir),
        views.view(spark, sf_dir, "boundary"),
        population_scan(spark, sf_dir),
    )


def feature_collection(spark, sf_dir):
    """Features written as collections, read back and split into features."""
    path = scratch.folder(spark, "collections")
    writers.write_collections(geojson_features(spark, sf_dir), path)
    lines = files.read_feature_collection(spark, path)
    names = "geoid STRING, total_patrons BIGINT, pct_cardholders DOUBLE, namelsad STRING"
    found = files.parse_boundary_features(lines.select("value"), names)
    return found


def published(output: str) -> Query:
    """An output that was published for a day, and once more for the same day."""

    def query(spark, sf_dir):
        root = scratch.folder(spark, "published")
        inputs = (
            views.tables(spark, sf_dir),
            views.catalogue(spark, sf_dir),
            views.view(spark, sf_dir, "boundary"),
            population_scan(spark, sf_dir),
        )
        outputs = (output,) if output in jobs.LAYERS else ()
        for least in (MIN_PATRONS, None):
            tractwise.publish(
                *inputs, root=root, run_date=AS_OF, outputs=outputs, min_patrons=least
            )
        form = "text" if output == "features" else "parquet"
        return tractwise.read_published(spark, root, output, form=form)

    return query


QUERIES: dict[str, Query] = {
    "population_scan": population_scan,
    "boundary_scan": boundary_scan,
    "population_lines": population_lines,
    "boundary_lines": boundary_lines,
    "population_kept": population_kept,
    "population_rejected": population_rejected,
    "boundary_kept": boundary_kept,
    "boundary_rejected": boundary_rejected,
    "catalogue_lines": catalogue_lines,
    "catalogue_problems": catalogue_problems,
    "key_violations": key_violations,
    "service_area_tracts": service_area,
    "service_area_views": service_area_views,
    "census_code_clean": census_code_clean,
    "tract_code": tract_code,
    "geoid_case": geoid_case,
    "census_url": census_url,
    "census_field_match": census_field_match,
    "tract_filter": tract_filter,
    "tract_join": tract_join,
    "patron_age": patron_age,
    "patron_measures": patron_measures,
    "patron_creation": patron_creation,
    "mailing_addresses": mailing_addresses,
    "patron_holds": patron_holds,
    "patron_areas": patron_areas,
    "patron_stats": patron_stats,
    "patron_stats_distinct_holds": patron_stats_distinct_holds,
    "patron_stats_direct": patron_stats_direct,
    "patron_stats_repeated_keys": patron_stats_repeated_keys,
    "patron_stats_stored": patron_stats_stored,
    "patron_stats_indexed": patron_stats_indexed,
    "patron_stats_indexed_tract": patron_stats_indexed_tract,
    "patron_refresh": patron_refresh,
    "patron_refresh_compacted": patron_refresh_compacted,
    "patron_stats_tract": stats_at("tract"),
    "patron_stats_county": stats_at("county"),
    "patron_stats_state": stats_at("state"),
    "patron_rollup": patron_rollup,
    "patron_stats_all_libraries": library_stats,
    "library_rollup": library_rollup,
    "stats_min_patrons": stats_min_patrons,
    "map_layer": map_layer,
    "pct_cardholders": pct_cardholders,
    "unmatched_areas": unmatched_areas,
    "label_cardholder": label_cardholder,
    "label_dual": label_dual,
    "label_metric": label_metric,
    "cardholder_layer": cardholder_layer,
    "dual_layer": dual_layer,
    "metric_long": metric_long,
    "geojson_features": geojson_features,
    "feature_collection": feature_collection,
    **{f"published_{name}": published(name) for name in ("stats", *jobs.LAYERS)},
}
