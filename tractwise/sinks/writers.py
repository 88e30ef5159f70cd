"""Single partitioned outputs.

A run replaces the partitions that it has rows for when Spark commits it, so a run that fails
leaves them as they were. A library without rows keeps its old partition; where that
matters, or several outputs belong together, use ``versions``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from tractwise.operators.layers import collection_lines


def _write(frame: DataFrame, path: str, partitions: list[str], form: str) -> None:
    # Rebalancing gives each partition directory few, even files and still splits
    # a library that is much larger than the others.
    (
        frame.hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .format(form)
        .save(path)
    )


def write_dated(frame: DataFrame, path: str, run_date: date, form: str = "parquet") -> None:
    """One partition per library and day; the same day's rerun replaces it."""
    _write(
        frame.withColumn("run_date", F.lit(run_date)), path, ["library", "run_date"], form
    )


def write_current(frame: DataFrame, path: str, form: str = "parquet") -> None:
    """One partition per library, replaced by every run."""
    _write(frame, path, ["library"], form)


def write_features(features: DataFrame, path: str, run_date: date | None = None) -> None:
    """Line-delimited GeoJSON, one feature per line, dated if a day is given."""
    lines = features.select("library", F.col("feature").alias("value"))
    if run_date is None:
        write_current(lines, path, "text")
    else:
        write_dated(lines, path, run_date, "text")


def write_collections(features: DataFrame, path: str) -> None:
    """One GeoJSON collection a library, in parts that follow each other by file name.

    Lines are dealt over tasks by ranges and sorted there, so a collection may be larger than
    a task: the files of a library, one after the other, are one document. Replaced by
    every run; a library without features has no file.
    """
    order = ("library", "place", "key")
    (
        collection_lines(features)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("library", "value")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("library")
        .text(path)
    )
