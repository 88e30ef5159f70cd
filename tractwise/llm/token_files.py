"""Token files: documents as ids in directly addressable codes, in order of doc_id.

A token folder is a Parquet table without compression, one row a segment:

- ``part``, ``segment``: place in the order of the corpus,
- ``start``, ``n_tokens``: ids of the part before the segment, and in it,
- ``doc_ids``, ``doc_starts``: the segment's documents and where each begins in it,
- ``codes``: the ids (see ``dac``).

A document lies in one segment. Spark's writer commits it, so a lost executor or a
task that runs twice leaves no half file and no second copy.

Nulls: a null text is an empty one, a null doc_id sorts first. Rows with one doc_id
stand in the order of a hash of their texts, equal rows beside each other. An empty
table gives an empty folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tractwise.llm.common import bounded_batches
from tractwise.llm.dac import Codes, pack
from tractwise.llm.vocab import END_ID, word_encoder

#: A segment is closed by the document that brings it to this many ids.
SEGMENT_TOKENS = 1 << 18

SCHEMA = (
    "part int, segment int, start long, n_tokens long,"
    " doc_ids array<long>, doc_starts array<long>, codes binary"
)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment: int = SEGMENT_TOKENS
) -> None:
    """Encode ``text`` and write it in order of ``doc_id``.

    One shuffle: ranges of (doc_id, hash of the text), so that one frequent doc_id is
    no hot range. Encoding and packing follow in the same tasks.
    """
    bounded_batches(docs.sparkSession)
    ordered = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    end = np.array([end_id], "<u4").tobytes()
    arrow = pa.schema(
        [
            ("part", pa.int32()),
            ("segment", pa.int32()),
            ("start", pa.int64()),
            ("n_tokens", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())),
            ("doc_starts", pa.list_(pa.int64())),
            ("codes", pa.binary()),
        ]
    )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(tokenizer), TaskContext.get().partitionId()
        number = start = size = 0
        doc_ids: list[int | None] = []
        starts: list[int] = []
        ids: list[bytes] = []

        def closed() -> pa.RecordBatch:
            row = [part, number, start, size, doc_ids, starts]
            codes = pack(np.frombuffer(b"".join(ids), "<u4"))
            return pa.RecordBatch.from_pylist(
                [dict(zip(arrow.names, [*row, codes], strict=True))], schema=arrow
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                encoded = encoder.encode(text.as_py()) + end
                doc_ids.append(doc_id.as_py())
                starts.append(size)
                ids.append(encoded)
                size += len(encoded) // 4
                if size >= segment:
                    yield closed()
                    number, start, size = number + 1, start + size, 0
                    doc_ids, starts, ids = [], [], []
        if doc_ids:
            yield closed()

    ordered.mapInArrow(segments, SCHEMA).write.option("compression", "none").parquet(path)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each part; a row a part, so the one window is as small as the part count."""
    totals = (
        spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("size"))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids of every document, from the files."""
    bounded_batches(spark)
    kind = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"
    arrow = pa.schema(
        [
            ("part", pa.int32()),
            ("doc_id", pa.int64()),
            ("start", pa.int64()),
            ("n_tokens", pa.int64()),
            ("ids_crc32", pa.int64()),
        ]
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, start, doc_ids, starts, data = (c[row].as_py() for c in batch.columns)
                codes = Codes(data)
                stops = [*starts[1:], len(codes)]
                crcs = [
                    zlib.crc32(codes.slice(a, b).astype("<u4").tobytes())
                    for a, b in zip(starts, stops, strict=True)
                ]
                sizes = [b - a for a, b in zip(starts, stops, strict=True)]
                columns = [[part] * len(starts), doc_ids, [start + a for a in starts], sizes, crcs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)],
                    schema=arrow,
                )

    segments = spark.read.schema(SCHEMA).parquet(path)
    rows = segments.select("part", "start", "doc_ids", "doc_starts", "codes").mapInArrow(
        documents, kind
    )
    return rows.join(directory(spark, path), "part").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at a position of the whole corpus. Filters reach the scan, one segment is read."""
    found = directory(spark, path).filter(F.col("base") <= position).orderBy(F.desc("base"))
    for part, base in found.take(64):
        inside = position - base
        row = (
            spark.read.schema(SCHEMA)
            .parquet(path)
            .filter((F.col("part") == part) & (F.col("start") <= inside))
            .filter(F.col("start") + F.col("n_tokens") > inside)
            .select("start", "codes")
            .first()
        )
        if row is not None:
            return Codes(bytes(row.codes))[inside - row.start]
    raise IndexError(position)
