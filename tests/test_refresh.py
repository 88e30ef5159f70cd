"""State that is brought up to date by changes, against statistics of whole tables."""

import random
from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import tractwise
from tests import small
from tests.small import TODAY, patron
from tractwise.plans import refresh
from tractwise.sinks import versions
from tractwise.sources.schemas import TABLES


def sound_data(seed):
    """Random tables with unique holds."""
    rows = small.random_data(seed, hot=True)
    rows["hold"] = list({hold[0]: hold for hold in rows["hold"]}.values())
    return rows


def stats_of(frame):
    return sorted(tuple(row) for row in frame.collect())


def changed(rows, seed):
    """The same tables on another day: rows are gone, new and different in each."""
    rng, other = random.Random(seed), sound_data(seed + 50)

    def some(table):
        return [row for row in rows[table] if rng.random() < 0.7]

    different = {row[0]: row for row in other["patron_record"]}
    records = [row if rng.random() < 0.6 else different[row[0]] for row in rows["patron_record"]]
    return {
        "patron_record": records[3:],
        "record_metadata": other["record_metadata"],
        "patron_record_address": some("patron_record_address") + other["patron_record_address"][:9],
        "hold": some("hold") + [(5000 + 1000 * seed + n, 1 + n % 40) for n in range(9)],
        "varfield": some("varfield") + other["varfield"][:20],
    }


def test_refreshed_totals_equal_statistics_of_whole_tables(spark, tmp_path):
    root, rows = str(tmp_path), sound_data(1)
    before = small.tables(spark, rows)
    refresh.start(before, root)
    for day in range(2):
        rows = changed(rows, day)
        after = small.tables(spark, rows)
        refresh.refresh(refresh.signed_changes(before, after), root)
        totals = refresh.read_totals(spark, root)
        for as_of in (TODAY, date(2023, 3, 1)):
            expected = tractwise.patron_stats_direct(after, as_of=as_of)
            assert stats_of(refresh.totals_stats(totals, as_of)) == stats_of(expected)
        before = after
    nothing = replace(after, **{n: getattr(after, n).limit(0).withColumn("sign", F.lit(1)) for n in TABLES})
    refresh.refresh(nothing, root)
    assert stats_of(refresh.totals_stats(refresh.read_totals(spark, root), TODAY)) == stats_of(
        tractwise.patron_stats_direct(after, as_of=TODAY)
    )


def test_a_refresh_touches_changed_patrons_only(spark, tmp_path):
    root = str(tmp_path)
    tables = small.tables(spark, small.data([patron(i) for i in range(1, 31)]))
    refresh.start(tables, root)
    more = small.data([patron(99)])
    change = small.tables(spark, more)
    signed = replace(change, **{n: getattr(change, n).withColumn("sign", F.lit(1)) for n in TABLES})
    old, new = refresh.changed_state(refresh.read_state(spark, root), signed)
    assert [row.id for row in new.collect()] == [99] and old.isEmpty()
    refresh.refresh(signed, root)
    log = [row.version for row in versions.published_versions(spark, root, "patrons")]
    counts = [spark.read.parquet(versions.version_path(root, "patrons", v)).count() for v in log]
    assert counts == [30, 1]
    # the same patron goes again
    gone = replace(change, **{n: getattr(change, n).withColumn("sign", F.lit(-1)) for n in TABLES})
    refresh.refresh(gone, root)
    found = refresh.totals_stats(refresh.read_totals(spark, root), TODAY)
    assert stats_of(found) == stats_of(tractwise.patron_stats(tables, as_of=TODAY))


def test_a_refresh_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    tables = small.tables(spark, small.data([patron(1, active=datetime(2024, 2, 1))]))
    refresh.start(tables, root)
    before = stats_of(refresh.totals_stats(refresh.read_totals(spark, root), TODAY))
    signed = replace(tables, **{n: getattr(tables, n).withColumn("sign", F.lit(-1)) for n in TABLES})
    broken = signed.varfield.withColumn("field_content", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        refresh.refresh(replace(signed, varfield=broken), root)
    monkeypatch.setattr(versions, "point", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        refresh.refresh(signed, root)
    assert stats_of(refresh.totals_stats(refresh.read_totals(spark, root), TODAY)) == before
    monkeypatch.undo()
    refresh.refresh(signed, root)
    assert refresh.totals_stats(refresh.read_totals(spark, root), TODAY).isEmpty()
    with pytest.raises(ValueError, match="never been published"):
        refresh.read_totals(spark, f"{root}/other")


def log_of(spark, root):
    return [row.version for row in versions.published_versions(spark, root, "patrons")]


def test_a_log_is_compacted_between_refreshes(spark, tmp_path, monkeypatch):
    root, rows = str(tmp_path), sound_data(4)
    before = small.tables(spark, rows)
    refresh.start(before, root)
    for day in range(2):
        rows = changed(rows, day)
        after = small.tables(spark, rows)
        refresh.refresh(refresh.signed_changes(before, after), root)
        before = after
        # what is still part of the log is no leftover
        versions.sweep(spark, root)
        log, state = log_of(spark, root), refresh.read_state(spark, root).collect()
        assert len(log) == 2
        with monkeypatch.context() as patch:
            patch.setattr(versions, "point", lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                refresh.compact(spark, root)
        assert log_of(spark, root) == log
        refresh.compact(spark, root)
        (only,) = log_of(spark, root)
        assert only > max(log) and versions.sweep(spark, root) >= len(log)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        for version in log:
            path = versions.version_path(root, "patrons", version)
            assert files.load(path).where("path LIKE '%.parquet'").isEmpty()
        left = {row.id: row for row in refresh.read_state(spark, root).collect()}
        gone = [row for row in state if row.id not in left]
        assert all(left[row.id] == row for row in state if row.id in left)
        assert all(
            row.record is None and row.creation is None and not row.places
            and (row.addresses, row.holds) == (0, 0)
            for row in gone
        )
    totals = refresh.read_totals(spark, root)
    expected = stats_of(tractwise.patron_stats_direct(after, as_of=TODAY))
    assert stats_of(refresh.totals_stats(totals, TODAY)) == expected
    assert stats_of(refresh.totals_stats(refresh.area_totals(refresh.read_state(spark, root)), TODAY)) == expected


def test_a_patron_without_anything_leaves_the_log(spark, tmp_path):
    root = str(tmp_path)
    tables = small.tables(spark, small.data([patron(1), patron(2)], holds=[(7, 2)]))
    refresh.start(tables, root)
    one = small.tables(spark, small.data([patron(2)], holds=[(7, 2)]))
    gone = replace(one, **{n: getattr(one, n).withColumn("sign", F.lit(-1)) for n in TABLES})
    refresh.refresh(gone, root)
    assert sorted(row.id for row in refresh.read_state(spark, root).collect()) == [1, 2]
    refresh.compact(spark, root)
    assert [row.id for row in refresh.read_state(spark, root).collect()] == [1]
    with pytest.raises(ValueError, match="never been published"):
        refresh.compact(spark, f"{root}/other")
