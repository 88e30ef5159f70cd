"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractwise.llm.common import stored


def _signature(edges: DataFrame) -> tuple:
    """Count and order-free hash sums; two numbers reach the driver."""
    return tuple(
        edges.agg(
            F.count("*"),
            F.sum(F.xxhash64("high", "low") % 1_000_003),
            F.sum(F.xxhash64("low", "high") % 999_983),
        ).first()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); root is the least node reachable.

    Each round hangs the larger neighbours of a node on its least neighbour, then the
    smaller ones; some log n rounds make every component a star. Rounds are stored, so
    lineage stays short. The least neighbour is a partial minimum, and is stored before the
    join, which then has two shuffles of its own: Spark can split a node with very many
    neighbours, so it is no hot task. Loops and
    repeated links are allowed, null ends are ignored; no links give no rows.
    """
    edges = stored(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        .distinct(),
        "links",
    )
    before = _signature(edges)
    while True:
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("next")).unionByName(
            edges.select(F.col("low").alias("node"), F.col("high").alias("next"))
        )
        least = both.groupBy("node").agg(F.least("node", F.min("next")).alias("root"))
        least = stored(least, "least")
        large = stored(
            both.filter("next > node")
            .join(least, "node")
            .select(F.col("next").alias("high"), F.col("root").alias("low"))
            .distinct(),
            "large-stars",
        )
        least = stored(large.groupBy("high").agg(F.min("low").alias("root")), "least")
        small = (
            large.join(least, "high")
            .select(F.explode(F.array("high", "low")).alias("high"), F.col("root").alias("low"))
            .filter("high <> low")
            .distinct()
        )
        edges = stored(small, "stars")
        now = _signature(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
