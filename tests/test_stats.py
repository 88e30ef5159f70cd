"""Area statistics against plain Python and against the joined-row form."""

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import tractwise
from tests import brute, small
from tests.small import TODAY, patron
from verification import views

SF = "/root/testdata/sf0.01"


def rows(frame):
    return [tuple(row) for row in frame.collect()]


def one(spark, data, **options):
    result = tractwise.patron_stats(small.tables(spark, data), as_of=TODAY, **options).collect()
    assert len(result) == 1
    return result[0]


def test_holds_multiply_sums_but_not_patrons(spark):
    row = one(spark, small.data([patron(1)], holds=[(1, 1), (2, 1), (3, 1)]))
    assert (row.total_patrons, row.total_checkouts, row.total_holds_current) == (1, 30, 3)
    assert (row.total_circ, row.total_checkouts_current, row.checkouts_per_patron) == (33, 6, "30.00")


def test_patron_without_holds_counts_once(spark):
    row = one(spark, small.data([patron(1)]))
    assert (row.total_patrons, row.total_checkouts, row.total_holds_current) == (1, 10, 0)


def test_repeated_holds_addresses_and_fields(spark):
    data = small.data(
        [patron(1)],
        addresses=[(1, "1"), (1, "1"), (1, "2")],
        holds=[(5, 1), (5, 1)],
        fields=[(1, "k", "|s25|c017|t383101|b1")] * 3,
    )
    row = one(spark, data)
    assert (row.total_patrons, row.total_checkouts, row.total_holds_current) == (1, 120, 1)


def test_tract_matches_in_any_county(spark):
    fields = [(1, "k", "|s25|c017|t383101|b1"), (2, "k", "|s25|c021|t383101|b1"), (3, "k", "|s25|c017|t999999|b1")]
    tables = small.tables(spark, small.data([patron(1), patron(2), patron(3)], fields=fields))
    found = tractwise.patron_stats(tables, ["383101"], TODAY).collect()
    assert {row.geoid for row in found} == {"250173831011", "250213831011"}


@pytest.mark.parametrize("seed, hot", [(1, False), (2, True)])
@pytest.mark.parametrize("level", ["block_group", "county"])
def test_equals_plain_python(spark, seed, hot, level):
    data = small.random_data(seed, hot)
    expected = brute.stats(data, TODAY, {"383101", "980000"}, level)
    tables = small.tables(spark, data)
    tracts = "'383101','980000'"
    assert rows(tractwise.patron_stats(tables, tracts, TODAY, level)) == expected
    assert rows(tractwise.patron_stats_direct(tables, tracts, TODAY, level)) == expected


def test_rollup_equals_plain_python(spark):
    data = small.random_data(3, hot=True)
    found = tractwise.rollup_stats(small.tables(spark, data), as_of=TODAY).collect()
    for level in brute.LENGTHS:
        expected = brute.stats(data, TODAY, None, level)
        assert [tuple(row)[1:] for row in found if row.level == level] == expected


def test_stored_patrons_give_equal_results(spark, tmp_path):
    data = small.random_data(4, hot=True)
    tables = small.tables(spark, data)
    expected = brute.stats(data, TODAY, {"383101"})
    reduced = tractwise.patron_stats(tables, ["383101"], TODAY, store_at=f"{tmp_path}/one")
    assert rows(reduced) == expected
    catalogue = tractwise.catalogue_of(spark, [("North", ["383101"])])
    library = tractwise.library_stats(tables, catalogue, TODAY, store_at=f"{tmp_path}/all")
    assert [tuple(row)[1:] for row in library.collect()] == expected
    plan = reduced._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 4 and "strategy=broadcast" not in plan


def test_unique_holds_equal_distinct_holds(spark):
    tables = views.tables(spark, SF)
    counted, distinct = [
        tractwise.patron_stats(replace(tables, unique_holds=unique), as_of=views.AS_OF)
        for unique in (True, False)
    ]
    assert rows(counted) == rows(distinct)


def test_library_job_equals_single_runs(spark):
    tables, catalogue = views.tables(spark, SF), views.catalogue(spark, SF)
    together = tractwise.library_stats(tables, catalogue, views.AS_OF).collect()
    asia = [tuple(row)[1:] for row in together if row.library == "ASIA"]
    assert asia == rows(tractwise.patron_stats(tables, views.ASIA_TRACTS, views.AS_OF))


def test_tract_of_two_libraries_counts_for_both(spark):
    tables = small.tables(spark, small.data([patron(1), patron(2)]))
    catalogue = tractwise.catalogue_of(
        spark, [("North", "'383101','383101'"), ("South", ["383101"]), ("South", ["383101", "380000"])]
    )
    found = tractwise.library_stats(tables, catalogue, TODAY).collect()
    assert [(row.library, row.total_patrons) for row in found] == [("North", 2), ("South", 2)]


def test_parts_do_not_exceed_patrons(spark):
    stats = tractwise.patron_stats(views.tables(spark, SF), as_of=views.AS_OF)
    parts = ("total_new_patrons", "total_active_patrons", "total_blocked_patrons")
    assert stats.where(F.greatest(*parts) > F.col("total_patrons")).count() == 0


def test_minimum_group_size(spark):
    fields = [(1, "k", "|s25|c017|t383101|b1"), (2, "k", "|s25|c017|t383101|b1"), (3, "k", "|s25|c017|t383101|b2")]
    row = one(spark, small.data([patron(1), patron(2), patron(3)], fields=fields), min_patrons=2)
    assert (row.geoid, row.total_patrons) == ("250173831011", 2)


def test_rollup_takes_one_kind_of_filter(spark):
    tables = small.tables(spark, small.data([patron(1)]))
    with pytest.raises(ValueError, match="not both"):
        tractwise.rollup_stats(tables, ["383101"], tractwise.catalogue_of(spark, [("N", ["383101"])]))


def test_key_violations(spark):
    sound = small.data([patron(1), patron(2)], holds=[(1, 1), (1, 1), (2, 2), (None, 2), (None, 1)])
    assert tractwise.key_violations(small.tables(spark, sound)).count() == 0
    assert rows(tractwise.key_violations(small.tables(spark, sound, unique_holds=True))) == [("hold", 1, 2)]
    broken = small.data(
        [patron(1), patron(1), patron(2)],
        metadata=[(1, datetime(2024, 1, 1)), (2, None), (2, None)],
        holds=[(9, 1), (9, 2)],
    )
    found = rows(tractwise.key_violations(small.tables(spark, broken)))
    assert sorted(found) == [("hold", 9, 2), ("patron_record", 1, 2), ("record_metadata", 2, 2)]


def test_direct_form_takes_keys_that_repeat(spark):
    data = small.data(
        [patron(1, checkouts=10), patron(1, checkouts=5, code="b"), patron(2, checkouts=1)],
        addresses=[(1, "1"), (1, "1"), (2, "1")],
        metadata=[(1, datetime(2024, 1, 1)), (2, None), (2, datetime(2020, 1, 1))],
        holds=[(9, 1), (9, 2), (9, 1), (None, 2), (8, 7)],
    )
    [found] = tractwise.patron_stats_direct(small.tables(spark, data), as_of=TODAY).collect()
    # patron 1: two fields by two addresses by two holds; patron 2: two metadata rows by two holds
    assert found.total_checkouts == 8 * (10 + 5) + 4 * 1
    assert (found.total_patrons, found.total_holds_current) == (2, 1)
    assert (found.total_new_patrons, found.total_blocked_patrons) == (1, 1)
