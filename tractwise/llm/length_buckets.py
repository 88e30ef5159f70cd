"""Packing into optimal length buckets.

Every document is cut into pieces of at most ``context`` tokens. One histogram counts
the pieces of each length. Dynamic programming over it chooses ``buckets`` upper bounds
such that padding every piece to its bucket's bound costs the fewest tokens in all. In
each bucket, pieces in order of document make batches of as many pieces as fit into
``budget`` tokens after padding.

Nulls: a null length counts as 0; a document without tokens is one piece of length 0,
which is padded like any other. A null doc_id comes first. Documents with one doc_id
are ordered by ``tie`` and then arbitrarily among equal rows. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractwise.llm.common import map_arrow, stored
from tractwise.llm.vocab import word_encoder

CONTEXT, BUCKETS, BUDGET = 2048, 12, 65_536


def token_counts(docs: DataFrame, tokenizer: str, end_tokens: int = 1) -> DataFrame:
    """doc_id, n_tokens with the end id, and a hash of the text as ``tie``."""

    def make():
        encoder = word_encoder(tokenizer)

        def apply(columns):
            ids, texts, ties = columns
            return [ids, [len(encoder.encode(t)) // 4 + end_tokens for t in texts], ties]

        return apply

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", "text", F.xxhash64("text").alias("tie")),
        f"doc_id {kind}, n_tokens long, tie long",
        make,
    )


def bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Ascending upper bounds with the least padding; of equal ones the lower bounds.

    ``cost[k][j]``: padding of the ``j`` shortest lengths in ``k`` buckets. One bucket
    for lengths i to j costs ``length_j * pieces - tokens`` over them.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(length)] for length in lengths], np.int64)
    pieces = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths)))
    n, buckets = len(lengths), min(buckets, len(lengths))
    never = np.iinfo(np.int64).max // 2
    cost = np.full(n + 1, never)
    cost[0] = 0
    cuts = np.zeros((buckets + 1, n + 1), np.int64)
    for k in range(1, buckets + 1):
        new = np.full(n + 1, never)
        for j in range(k, n + 1):
            one = lengths[j - 1] * (pieces[j] - pieces[:j]) - (tokens[j] - tokens[:j])
            total = cost[:j] + one
            cuts[k, j] = at = int(total.argmin())
            new[j] = total[at]
        cost = new
    found, j = [], n
    for k in range(buckets, 0, -1):
        found.append(int(lengths[j - 1]))
        j = int(cuts[k, j])
    return found[::-1]


def numbered(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``, the place of a piece in its bucket by (doc_id, tie, piece), from 0.

    Ranges over all buckets at once are sorted and numbered task by task; a small table
    of counts a range and bucket gives what comes before. No bucket is one task.
    """
    ordered = pieces.repartitionByRange("bucket", "doc_id", "tie", "piece").sortWithinPartitions(
        "bucket", "doc_id", "tie", "piece"
    )
    extra = [T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())]
    schema = T.StructType([*pieces.schema.fields, *extra])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            places = np.zeros(len(buckets), np.int64)
            starts = np.flatnonzero(np.diff(buckets, prepend=buckets[:1])).tolist()
            for first, stop in zip([0, *starts], [*starts, len(buckets)], strict=True):
                if first == stop:
                    continue
                if buckets[first] != current:
                    current, count = buckets[first], 0
                places[first:stop] = np.arange(count, count + stop - first)
                count += stop - first
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(np.full(len(buckets), part, np.int32)),
                    pa.array(places),
                ],
                names=[*batch.schema.names, "part", "place"],
            )

    local = stored(ordered.mapInArrow(number, schema), "pieces")
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = local.groupBy("bucket", "part").agg(F.count("*").alias("size"))
    bases = counts.select(
        "bucket", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")
    )
    return (
        local.join(bases, ["bucket", "part"])
        .withColumn("rank", F.col("base") + F.col("place"))
        .drop("part", "place", "base")
    )


def packed(
    lengths: DataFrame, context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET
) -> DataFrame:
    """A row a piece: doc_id, piece, first_token, n_tokens, bucket, bucket_len, batch, slot.

    ``lengths`` has doc_id, n_tokens and tie. The histogram has at most ``context`` + 1
    rows, whatever the corpus; it and the bounds are all that reaches the driver.
    """
    if budget < context:
        raise ValueError("a batch must hold at least one piece of full length")
    size = F.coalesce(F.col("n_tokens"), F.lit(0))
    last = F.greatest(F.ceil(size / context).cast("int"), F.lit(1)) - 1
    pieces = lengths.select(
        "doc_id", "tie", size.alias("size"), F.explode(F.sequence(F.lit(0), last)).alias("piece")
    ).select(
        "doc_id",
        "tie",
        "piece",
        (F.col("piece").cast("long") * context).alias("first_token"),
        F.least(F.lit(context), F.col("size") - F.col("piece").cast("long") * context)
        .cast("int")
        .alias("n_tokens"),
    )
    counted = pieces.groupBy("n_tokens").agg(F.count("*").alias("pieces")).collect()
    found = bounds({row.n_tokens: row.pieces for row in counted}, buckets) or [context]
    upper = F.array(*[F.lit(b) for b in found])
    bucket = sum((F.col("n_tokens") > b).cast("int") for b in found[:-1]) + F.lit(0)
    placed = pieces.withColumn("bucket", bucket.cast("int"))
    per_batch = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1))), F.lit(1))
    return (
        numbered(placed)
        .withColumn("bucket_len", F.element_at(upper, F.col("bucket") + 1))
        .select(
            "doc_id",
            "piece",
            "first_token",
            "n_tokens",
            "bucket",
            "bucket_len",
            F.floor(F.col("rank") / per_batch).alias("batch"),
            (F.col("rank") % per_batch).alias("slot"),
        )
    )
