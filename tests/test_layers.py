"""Layers, sinks and whole jobs."""

import json
from dataclasses import replace
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import tractwise
from tractwise.functions import fixed
from tractwise.operators import layers
from tractwise.plans import jobs
from tractwise.sinks import versions, writers
from tests import small
from tests.small import TODAY, patron
from verification import queries, views

GEOMETRY = '{"type":"Point","coordinates":[-71.50,42.25]}'


@pytest.fixture(scope="module")
def inputs(spark):
    fields = [
        (1, "k", "|s25|c017|t383101|b1"),
        (2, "k", "|s25|c017|t383101|b1"),
        (3, "k", "|s25|c017|t383101|b2"),
        (4, "k", "|s25|c017|t383102|b1"),
        (5, "k", "|s25|c017|t383102|b2"),
    ]
    tables = small.tables(spark, small.data([patron(i) for i in range(1, 6)], fields=fields))
    catalogue = tractwise.catalogue_of(
        spark, [("North", ["383101"], 42.25, -71.5, 11), ("South", ["383102"])]
    )
    population = spark.createDataFrame(
        [("250173831011", "Group 1", 16), ("250173831012", "Group 2", 0), ("250173831022", "Group 3", 3)],
        "geoid STRING, geographic_area_name STRING, estimated_population BIGINT",
    )
    boundary = spark.createDataFrame(
        [("250173831011", GEOMETRY), ("250173831012", None), ("250173831021", GEOMETRY)],
        "GEOID STRING, geometry_json STRING",
    )
    return tables, catalogue, boundary, population


@pytest.fixture(scope="module")
def layer(inputs):
    tables, catalogue, boundary, population = inputs
    return tractwise.map_layer(tractwise.library_stats(tables, catalogue, TODAY), boundary, population)


def test_layer_keeps_matched_areas_only(layer):
    assert sorted((row.geoid, row.pct_cardholders) for row in layer.collect()) == [
        ("250173831011", 12.5),
        ("250173831012", None),
    ]


def test_unmatched_areas_say_what_is_missing(inputs):
    tables, catalogue, boundary, population = inputs
    stats = tractwise.library_stats(tables, catalogue, TODAY)
    found = tractwise.unmatched_areas(stats, boundary, population).collect()
    assert sorted((row.geoid, row.has_boundary, row.has_population) for row in found) == [
        ("250173831021", True, False),
        ("250173831022", False, True),
    ]


def test_metric_long_has_ten_rows_per_area_and_keeps_nulls(layer):
    rows = tractwise.metric_long(layer).where(F.col("geoid") == "250173831012").orderBy("metric_order").collect()
    assert [row.metric for row in rows] == fixed.METRICS
    assert [row.is_default for row in rows] == [True] + [False] * 9
    percent = rows[2]
    assert (percent.value_text, percent.value, percent.label) == (None, None, None)
    assert rows[7].label == "<b>Group 2</b><br>Total: 100.00<extra></extra>"
    assert rows[7].value == 100.0


def test_dual_layer_panes(layer):
    rows = tractwise.dual_layer(layer).where(F.col("geoid") == "250173831011").orderBy("pane").collect()
    assert [(row.title, row.value) for row in rows] == [
        ("Cardholder Percentage", 12.5),
        ("Active Percentage", 100.0),
    ]


def test_single_library_layer_needs_no_library_column(inputs):
    tables, _, boundary, population = inputs
    one = tractwise.map_layer(tractwise.patron_stats(tables, ["383101"], TODAY), boundary, population)
    assert "library" not in tractwise.metric_long(one).columns
    assert tractwise.cardholder_layer(one).count() == 2


def test_features_are_json(layer):
    found = {row.geoid: json.loads(row.feature) for row in tractwise.geojson_features(layer).collect()}
    full, empty = found["250173831011"], found["250173831012"]
    assert full["geometry"] == {"type": "Point", "coordinates": [-71.5, 42.25]}
    assert full["properties"]["pct_active"] == "100.00"
    assert full["properties"]["pct_cardholders"] == 12.5
    assert "library" not in full["properties"]
    assert empty["geometry"] is None
    assert "pct_cardholders" in empty["properties"] and empty["properties"]["pct_cardholders"] is None


def test_features_can_be_read_as_boundaries(spark, layer, tmp_path):
    writers.write_features(tractwise.geojson_features(layer), f"{tmp_path}/f")
    back = tractwise.read_boundary_features(spark, f"{tmp_path}/f/library=North", ("geoid",))
    geometry = {row.geoid: row.geometry_json for row in back.collect()}
    assert set(geometry) == {"250173831011", "250173831012"}
    assert json.loads(geometry["250173831011"]) == json.loads(GEOMETRY)


def test_dated_output_keeps_days_and_replaces_reruns(spark, tmp_path):
    path = f"{tmp_path}/dated"
    first = spark.createDataFrame([("North", 1), ("South", 2)], "library STRING, n INT")
    again = spark.createDataFrame([("North", 9)], "library STRING, n INT")
    writers.write_dated(first, path, date(2024, 1, 1))
    writers.write_dated(first, path, date(2024, 1, 2))
    writers.write_dated(again, path, date(2024, 1, 2))
    rows = spark.read.parquet(path).select("library", F.col("run_date").cast("string"), "n").collect()
    assert sorted(tuple(row) for row in rows) == [
        ("North", "2024-01-01", 1),
        ("North", "2024-01-02", 9),
        ("South", "2024-01-01", 2),
        ("South", "2024-01-02", 2),
    ]


def test_current_output_is_replaced_per_library(spark, tmp_path):
    path = f"{tmp_path}/current"
    writers.write_current(spark.createDataFrame([("North", 1), ("South", 2)], "library STRING, n INT"), path)
    writers.write_current(spark.createDataFrame([("North", 9)], "library STRING, n INT"), path)
    rows = spark.read.parquet(path).select("library", "n").collect()
    assert sorted(tuple(row) for row in rows) == [("North", 9), ("South", 2)]


OUTPUTS = ("stats", "cardholder", "dual", "metrics", "features")


def published(spark, root, output):
    """Sorted valid rows of an output."""
    form = "text" if output == "features" else "parquet"
    rows = tractwise.read_published(spark, root, output, form=form).collect()
    return sorted((tuple(row) for row in rows), key=str)


def data_files(root, output):
    return [path for path in Path(root, output).rglob("part-*") if path.is_file()]


def test_publish(spark, inputs, tmp_path):
    root = str(tmp_path)
    for _ in range(2):
        tractwise.publish(*inputs, root=root, run_date=TODAY)
    counts = {name: len(published(spark, root, name)) for name in OUTPUTS}
    assert counts == {"stats": 4, "cardholder": 2, "dual": 4, "metrics": 20, "features": 2}
    single = tractwise.read_published(spark, root, "cardholder").orderBy("geoid").first()
    assert (single.library, single.value, single.lat, single.zoom) == ("North", 12.5, 42.25, 11)
    assert {row[-1] for row in published(spark, root, "stats")} == {TODAY}
    lines = [json.loads(value) for _, value in published(spark, root, "features")]
    assert sorted(line["properties"]["geoid"] for line in lines) == ["250173831011", "250173831012"]
    assert {library for library, _ in published(spark, root, "features")} == {"North"}


def test_publish_again_leaves_nothing_of_the_first_run(spark, inputs, tmp_path):
    root = str(tmp_path)
    tractwise.publish(*inputs, root=root, run_date=date(2024, 1, 1))
    first = {name: set(data_files(root, name)) for name in OUTPUTS}
    tractwise.publish(*inputs, root=root, run_date=TODAY)
    tractwise.publish(*inputs, root=root, run_date=TODAY, min_patrons=10**6)
    for name in ("stats", "dual", "metrics"):
        assert {row[-1] for row in published(spark, root, name)} == {date(2024, 1, 1)}, name
        assert set(data_files(root, name)) == first[name]
    for name in ("cardholder", "features"):
        found = tractwise.read_published(spark, root, name, "library STRING, value STRING", "text")
        assert found.isEmpty(), name
        assert not data_files(root, name), name


def failing(frame):
    """The same columns; reading rows raises."""
    names = [F.col(name) for name in frame.columns if name != "geoid"]
    return frame.select(F.raise_error(F.lit("broken input")).cast("string").alias("geoid"), *names)


@pytest.mark.parametrize("part", ["tables", "boundary", "population", "pointer"])
def test_a_run_that_fails_leaves_every_output_as_before(spark, inputs, tmp_path, part, monkeypatch):
    root, (tables, catalogue, boundary, population) = str(tmp_path), inputs
    tractwise.publish(*inputs, root=root, run_date=TODAY)
    before = {name: published(spark, root, name) for name in OUTPUTS}
    files = {name: set(data_files(root, name)) for name in OUTPUTS}
    if part == "tables":
        text = F.raise_error(F.lit("broken input")).cast("string")
        tables = replace(tables, varfield=tables.varfield.withColumn("field_content", text))
    if part == "boundary":
        boundary = failing(boundary.withColumnRenamed("GEOID", "geoid"))
    if part == "population":
        population = failing(population)
    if part == "pointer":
        monkeypatch.setattr(versions, "point", lambda *_: 1 / 0)
    with pytest.raises(Exception, match="broken input|division"):
        tractwise.publish(tables, catalogue, boundary, population, root=root, run_date=TODAY, min_patrons=2)
    assert {name: published(spark, root, name) for name in OUTPUTS} == before
    assert all(files[name] <= set(data_files(root, name)) for name in OUTPUTS)
    monkeypatch.undo()
    tractwise.publish(*inputs, root=root, run_date=TODAY, min_patrons=2)
    assert published(spark, root, "stats") != before["stats"]
    assert not any(files[name] & set(data_files(root, name)) for name in OUTPUTS)


def test_a_run_of_one_library_keeps_the_others(spark, inputs, tmp_path):
    root, (tables, catalogue, boundary, population) = str(tmp_path), inputs
    names = ("N/th: 1", "Süd")
    both = tractwise.catalogue_of(spark, [(names[0], ["383101"]), (names[1], ["383102"])])
    tractwise.publish(tables, both, boundary, population, root=root, run_date=TODAY)
    before = {name: published(spark, root, name) for name in OUTPUTS}
    one = tractwise.catalogue_of(spark, [(names[0], ["383101"])])
    tractwise.publish(tables, one, boundary, population, root=root, run_date=TODAY)
    assert {name: published(spark, root, name) for name in OUTPUTS} == before
    tractwise.publish(tables, one, boundary, population, root=root, run_date=TODAY, min_patrons=99)
    assert {row[0] for row in published(spark, root, "stats")} == {names[1]}
    assert tractwise.sweep(spark, root) == 0


def test_reading_what_was_never_published(spark, tmp_path):
    with pytest.raises(ValueError, match="never been published"):
        tractwise.read_published(spark, f"{tmp_path}/none", "stats")
    empty = tractwise.read_published(spark, f"{tmp_path}/none", "stats", "library STRING, n INT")
    assert empty.columns == ["library", "n"] and empty.isEmpty()
    assert not Path(f"{tmp_path}/none").exists()


def test_publish_counts_a_repeated_boundary_like_map_layer(spark, inputs, tmp_path):
    tables, catalogue, boundary, population = inputs
    twice = boundary.union(boundary)
    tractwise.publish(tables, catalogue, twice, population, root=str(tmp_path), run_date=TODAY)
    counts = [len(published(spark, str(tmp_path), name)) for name in ("cardholder", "features")]
    assert counts == [4, 4]


def test_publish_rejects_unknown_outputs(inputs, tmp_path):
    with pytest.raises(ValueError, match="unknown outputs"):
        tractwise.publish(*inputs, root=str(tmp_path), run_date=TODAY, outputs=("poster",))


def test_stored_stats_equal_computed_ones(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    tables, catalogue = views.tables(spark, sf_dir), views.catalogue(spark, sf_dir)
    stored = jobs.store_stats(tables, catalogue, f"{tmp_path}/stats", views.AS_OF)
    computed = queries.library_stats(spark, sf_dir)
    assert stored.columns == computed.columns
    assert stored.schema.simpleString() == computed.schema.simpleString()
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, computed.collect()))


def test_view_is_null_where_the_catalogue_has_none(inputs, layer):
    rows = layers.with_view(tractwise.cardholder_layer(layer), inputs[1]).collect()
    assert {row.library for row in rows} == {"North"}
    assert {row.lat for row in rows} == {42.25}


def test_equal_column_names_get_a_suffix(spark, inputs):
    tables, catalogue, boundary, population = inputs
    stats = tractwise.library_stats(tables, catalogue, TODAY)
    population = population.withColumn("avg_age", F.lit("p")).withColumn("ALAND", F.lit(1))
    boundary = boundary.withColumn("Avg_Age", F.lit("b")).withColumn("aland", F.lit(2))
    found = tractwise.map_layer(stats, boundary, population)
    first = found.first()
    assert (first.avg_age_population, first.avg_age_boundary) == ("p", "b")
    assert (first.ALAND, first.aland_boundary) == (1, 2)
    feature = json.loads(tractwise.geojson_features(found).first().feature)
    assert {"avg_age", "avg_age_population", "avg_age_boundary"} <= set(feature["properties"])


def test_publish_writes_nothing_if_keys_repeat(spark, inputs, tmp_path):
    tables, *others = inputs
    twice = replace(tables, patron_record=tables.patron_record.union(tables.patron_record))
    with pytest.raises(ValueError, match="patron_record"):
        tractwise.publish(twice, *others, root=f"{tmp_path}/out", run_date=TODAY, check_keys=True)
    assert not Path(f"{tmp_path}/out").exists()
