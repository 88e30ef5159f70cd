"""PostgreSQL through Spark's JDBC source, read in parallel key ranges."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import pairwise

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F


def jdbc_options(
    url: str,
    table: str,
    key: str,
    bounds: tuple[int, int],
    num_partitions: int,
    **options: str,
) -> dict[str, str]:
    """Options of a range-partitioned read; extra ones win over the defaults."""
    low, high = bounds
    if num_partitions < 1:
        raise ValueError("num_partitions must be at least 1")
    if low > high:
        raise ValueError(f"lower bound {low} is above upper bound {high}")
    return {
        "url": url,
        "dbtable": table,
        "driver": "org.postgresql.Driver",
        "partitionColumn": key,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(num_partitions),
        "fetchsize": "10000",
        **options,
    }


def jdbc_reader(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    bounds: tuple[int, int],
    num_partitions: int,
    **options: str,
) -> DataFrameReader:
    """Reader for one table. Credentials go into ``options`` (user, password)."""
    return spark.read.format("jdbc").options(
        **jdbc_options(url, table, key, bounds, num_partitions, **options)
    )


def key_cuts(keys: DataFrame, key: str, ranges: int, accuracy: int = 100_000) -> list[int]:
    """Ascending cut points that part the rows of ``keys`` into even ranges of ``key``.

    ``keys`` is any frame with the key, for example the table of yesterday or a table that
    refers to it. Quantiles come from one aggregation with a sketch of bounded size; as many
    numbers as ranges reach the driver. A key with many rows may be several cut points, of
    which one stays, so there can be fewer ranges.
    """
    if ranges < 1:
        raise ValueError("ranges must be at least 1")
    shares = [i / ranges for i in range(1, ranges)]
    if not shares:
        return []
    found = keys.agg(F.percentile_approx(key, shares, accuracy).alias("cuts")).first().cuts
    return sorted({int(cut) for cut in found or []})


def key_predicates(key: str, cuts: Iterable[int]) -> list[str]:
    """SQL conditions, one a range, that hold every row exactly once, also without a key."""
    cuts = sorted(set(cuts))
    if not cuts:
        return ["1 = 1"]
    first = f"{key} <= {cuts[0]} OR {key} IS NULL"
    inner = [f"{key} > {low} AND {key} <= {high}" for low, high in pairwise(cuts)]
    return [first, *inner, f"{key} > {cuts[-1]}"]


def jdbc_ranges(
    spark: SparkSession,
    url: str,
    table: str,
    predicates: list[str],
    **options: str,
) -> DataFrame:
    """One table, a task for each condition; uneven keys then make even tasks."""
    properties = {"driver": "org.postgresql.Driver", "fetchsize": "10000", **options}
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)
