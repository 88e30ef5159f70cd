"""Cardholder statistics per Census area, and map layers built on them."""

from tractwise.operators.checks import catalogue_problems, key_violations
from tractwise.operators.layers import (
    cardholder_layer,
    dual_layer,
    geojson_features,
    map_layer,
    metric_long,
    unmatched_areas,
    with_view,
)
from tractwise.plans.area_index import build_area_index, indexed_stats, read_area_index
from tractwise.plans.jobs import publish, store_stats
from tractwise.plans.stats import (
    library_stats,
    patron_stats,
    patron_stats_direct,
    rollup_stats,
)
from tractwise.sinks.versions import read_published, sweep
from tractwise.sinks.writers import write_collections
from tractwise.sources.catalogue import catalogue_of, parse_catalogue, read_catalogue
from tractwise.sources.files import (
    parse_boundary_features,
    parse_population,
    read_boundary_features,
    read_boundary_table,
    read_feature_collection,
    read_population,
    split_boundary_features,
    split_population,
)
from tractwise.sources.tables import (
    PatronTables,
    catalog_tables,
    jdbc_tables,
    parquet_tables,
    save_bucketed,
)

__all__ = [
    "PatronTables",
    "build_area_index",
    "cardholder_layer",
    "catalog_tables",
    "catalogue_of",
    "catalogue_problems",
    "dual_layer",
    "geojson_features",
    "indexed_stats",
    "jdbc_tables",
    "key_violations",
    "library_stats",
    "map_layer",
    "metric_long",
    "parquet_tables",
    "parse_boundary_features",
    "parse_catalogue",
    "parse_population",
    "patron_stats",
    "patron_stats_direct",
    "publish",
    "read_area_index",
    "read_boundary_features",
    "read_boundary_table",
    "read_catalogue",
    "read_feature_collection",
    "read_population",
    "read_published",
    "rollup_stats",
    "save_bucketed",
    "split_boundary_features",
    "split_population",
    "store_stats",
    "sweep",
    "unmatched_areas",
    "with_view",
    "write_collections",
]
