"""What the physical plans must look like on tables too large to broadcast."""

import re
from dataclasses import replace
from pathlib import Path

import pyarrow.parquet as pq
import pytest

import tractwise
from tests import small
from tests.small import TODAY, patron
from tractwise.plans import area_index

NO_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The five tables as parquet, which is what the scans are about."""
    root = str(tmp_path_factory.mktemp("tables"))
    tables = small.tables(spark, small.random_data(5))
    for name in ("patron_record", "patron_record_address", "record_metadata", "hold", "varfield"):
        getattr(tables, name).write.parquet(f"{root}/{name}")
    return tractwise.parquet_tables(spark, root)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set(NO_BROADCAST, "-1")
    yield
    spark.conf.unset(NO_BROADCAST)


def plan_of(frame):
    """Physical plan as text, with whole expressions."""
    spark = frame.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        return frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def exchanges(plan):
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    return sorted(re.sub(r"#\d+L?", "", key) for key in keys)


def test_one_shuffle_per_table_and_none_between_joins(stored, no_broadcast):
    plan = plan_of(tractwise.patron_stats(stored, ["383101"], TODAY))
    assert exchanges(plan) == sorted(
        [
            "geoid, id",  # count fields per patron and area
            "id",  # ... gather them by patron
            "id",  # patrons
            "id",  # addresses, already counted
            "id",  # metadata
            "id, hold_id",  # distinct holds, spread over hold ids
            "id",  # holds, already counted
            "geoid",  # totals, already summed
        ]
    )
    assert plan.count("SortMergeJoin") == 4
    for unwanted in ("Expand", "NestedLoop", "Cartesian", "Python", "Window"):
        assert unwanted not in plan


def test_unique_holds_save_a_shuffle(stored, no_broadcast):
    plan = plan_of(tractwise.patron_stats(replace(stored, unique_holds=True), ["383101"], TODAY))
    assert "id, hold_id" not in exchanges(plan)
    assert len(exchanges(plan)) == 7


def test_direct_form_neither_expands_nor_gathers_raw_holds_by_patron(stored, no_broadcast):
    plan = plan_of(tractwise.patron_stats_direct(stored, ["383101"], TODAY))
    assert "Expand" not in plan
    assert "geoid, hold_id" in exchanges(plan)
    # holds meet areas by patron and part; by patron alone only counts do
    assert exchanges(plan).count("id, part") == 2


def test_filters_and_columns_reach_the_scans(stored):
    plan = plan_of(tractwise.patron_stats(stored, ["383101"], TODAY))
    assert "EqualTo(varfield_type_code,k)" in plan
    assert "StringStartsWith(field_content,|s)" in plan
    assert "EqualTo(patron_record_address_type_id,1)" in plan
    assert "ReadSchema: struct<id:bigint,creation_date_gmt:timestamp>" in plan
    assert "ReadSchema: struct<id:bigint,patron_record_id:bigint>" in plan


def test_tract_filter_runs_at_the_scan(stored):
    plan = plan_of(tractwise.patron_stats(stored, ["383101"], TODAY))
    [condition] = [line for line in plan.splitlines() if "Filter (" in line and "383101" in line]
    assert "RLIKE" in condition


def test_fields_are_cleaned_once_per_library_join(spark, stored, no_broadcast):
    catalogue = tractwise.catalogue_of(spark, [("North", ["383101"])])
    plan = plan_of(tractwise.library_stats(stored, catalogue, TODAY))
    assert plan.count("regexp_replace") == 1


def test_known_catalogue_is_broadcast_by_its_size(spark, stored):
    catalogue = tractwise.catalogue_of(spark, [("North", ["383101"])])
    size = catalogue._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) < 10_000


def test_layers_do_not_carry_geometry(spark, stored, tmp_path):
    stats = tractwise.patron_stats(stored, as_of=TODAY)
    spark.createDataFrame([], "geoid STRING, geometry_json STRING").write.parquet(f"{tmp_path}/b")
    boundary = tractwise.read_boundary_table(spark, f"{tmp_path}/b")
    population = spark.createDataFrame(
        [], "geoid STRING, geographic_area_name STRING, estimated_population BIGINT"
    )
    layer = tractwise.map_layer(stats, boundary, population)
    assert "geometry_json" in layer.columns
    assert "geometry_json" not in plan_of(tractwise.metric_long(layer))


def test_bucketed_tables_are_not_shuffled(spark, tmp_path, no_broadcast):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/bucketed'")
    try:
        tables = small.tables(spark, small.data([patron(1), patron(2)], holds=[(1, 1)]))
        tractwise.save_bucketed(tables, "bucketed", 8)
        read = tractwise.catalog_tables(spark, "bucketed")
        stats = tractwise.patron_stats(read, as_of=TODAY)
        assert len(exchanges(plan_of(stats))) == 6
        assert stats.first().total_patrons == 2
    finally:
        spark.sql("DROP DATABASE bucketed CASCADE")


def test_rollup_counts_all_levels_in_one_chain(stored, no_broadcast):
    one = exchanges(plan_of(tractwise.patron_stats(stored, ["383101"], TODAY)))
    plan = plan_of(tractwise.rollup_stats(stored, ["383101"], as_of=TODAY))
    # one more, of a row for each area and level; patrons are neither moved nor copied again
    assert sorted(one + ["level, area"]) == exchanges(plan)
    head, _, tail = plan.partition("count_if" if "count_if" in plan else "partial_count")
    assert "block_group" in head and "Generate inline" not in tail


def test_direct_form_copies_only_frequent_patrons(stored, no_broadcast):
    plan = plan_of(tractwise.patron_stats_direct(stored, ["383101"], TODAY))
    assert "approx_top_k" in plan
    assert "sequence(0, 15" not in plan


def test_index_skips_row_groups_and_joins_nothing(spark, tmp_path):
    rows = [patron(i) for i in range(1, 4001)]
    fields = [(i, "k", f"|s25|c017|t{381000 + i % 40:06d}|b1") for i in range(1, 4001)]
    tables = small.tables(spark, small.data(rows, fields=fields))
    path = f"{tmp_path}/index"
    area_index.build_area_index(tables, path, ranges=10)
    index = area_index.read_area_index(spark, path)
    plan = plan_of(area_index.indexed_stats(index, ["381007"], TODAY))
    assert "EqualTo(tract,381007)" in plan
    assert "Join" not in plan and len(exchanges(plan)) == 1
    groups = [
        (file.metadata.row_group(g).column(0).statistics, file.metadata.row_group(g).num_rows)
        for part in Path(path).glob("*.parquet")
        for file in [pq.ParquetFile(part)]
        for g in range(file.metadata.num_row_groups)
    ]
    meets = [n for stats, n in groups if stats.min <= "381007" <= stats.max]
    # the tract is in one row group or two, of those of eight files at least
    assert len(groups) >= 8 and len(meets) <= 2
    assert area_index.indexed_stats(index, ["381007"], TODAY).first().total_patrons == 100
    bloom = pq.ParquetFile(next(Path(path).glob("*.parquet"))).metadata.row_group(0).column(2)
    assert bloom.path_in_schema == "id"
    assert [tuple(r) for r in area_index.areas_of_patron(index, 77).collect()] == [
        ("381037", "250173810371", 1)
    ]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        area_index.build_area_index(tables, path)
