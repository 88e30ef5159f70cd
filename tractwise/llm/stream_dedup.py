"""Exact deduplication as a stream with keyed state on disk.

Three steps, each restartable:

1. ``digests``: a stateless stream reads new files and writes doc_id, locator and digest
   of the normalised text. The locator is the file and the row in it.
2. ``state``: a stateful stream over these rows keeps, for every digest ever seen, the
   document that stays, its locator and the number of rows. State lives in RocksDB and
   never expires; rows of one digest are summed before the shuffle, so that a text with
   a third of all rows is a few rows when it arrives. Each micro-batch replaces its own
   output folder, so a batch that runs twice counts once.
3. ``verified``: texts of digests with several rows are fetched by locator and compared
   in full. Equal texts have the same least and greatest text, which again is summed
   before the shuffle. Digests that stand for different texts are regrouped by text.

Texts are equal when identical after lower-casing A to Z. The row with the largest
doc_id stays; among rows with that id, the one with the greatest locator.

Nulls: a null text is an empty one; a null doc_id is below every other. Rows that repeat
are separate rows of one group. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tractwise.llm.common import bounded_batches, shared_folder, stored

#: State on disk, saved as a log of changes; no disk space is reserved ahead of use, as
#: there is a store in each shuffle partition.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

DIGESTS = "doc_id long, locator struct<file:string,row:long>, digest binary"
STATE = (
    "digest binary, keeper struct<doc_id:long,locator:struct<file:string,row:long>>,"
    " group_size long, batch long"
)


def normalised(text: str | None) -> bytes:
    """UTF-8 with A to Z lower-cased; bytes.lower() touches nothing else."""
    return (text or "").encode().lower()


def digest_of(digest_bytes: int):
    @pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.sha256(normalised(t)).digest()[:digest_bytes])

    return digest


def normalised_bytes():
    @pandas_udf("binary")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(normalised)

    return normal


def _located(frame: DataFrame) -> DataFrame:
    """doc_id, text and locator of a Parquet scan, batch or stream."""
    return frame.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
        ).alias("locator"),
    )


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_digests(
    spark: SparkSession, documents: str, folder: str, digest_bytes: int, trigger: dict
) -> str:
    """Step 1: digests of all files under ``documents`` that this folder has not seen."""
    bounded_batches(spark)
    schema = spark.read.parquet(documents).select("doc_id", "text").schema
    out = f"{folder}/digests"
    # as a pattern the path may be a folder or one file; as a plain path only a folder
    path = documents.rstrip("/")
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    rows = _located(stream).select(
        "doc_id", "locator", digest_of(digest_bytes)("text").alias("digest")
    )
    _finish(
        rows.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/digests-checkpoint")
        .trigger(**trigger)
        .start(out)
    )
    return out


def stream_state(spark: SparkSession, digests: str, folder: str, files_per_batch: int) -> str:
    """Step 2: the state after all digests; one row a digest and batch that touched it."""
    out = f"{folder}/state"
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        stream = (
            spark.readStream.schema(DIGESTS)
            .option("maxFilesPerTrigger", files_per_batch)
            .parquet(digests)
        )
        grouped = stream.groupBy("digest").agg(
            F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count("*").alias("group_size")
        )

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(
                f"{out}/number={number}"
            )

        _finish(
            grouped.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/state-checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return out


def final_state(spark: SparkSession, state: str) -> DataFrame:
    """digest, keeper, group_size as of the last batch."""
    return (
        spark.read.schema(STATE)
        .parquet(state)
        .groupBy("digest")
        .agg(F.max("keeper").alias("keeper"), F.max("group_size").alias("group_size"))
    )


def exact_groups(
    spark: SparkSession,
    documents: str,
    folder: str | None = None,
    digest_bytes: int = 32,
    files_per_batch: int = 100_000,
    trigger: dict | None = None,
) -> DataFrame:
    """One row per document: doc_id, locator, digest, keep_id, group_size, kept.

    ``documents`` is a Parquet folder. Calling it again with the same ``folder`` reads
    only new files and merges them into the state; the result covers all of them.
    """
    folder = folder or shared_folder(spark, "exact")
    if spark.read.parquet(documents).isEmpty():
        return spark.createDataFrame([], f"{DIGESTS}, keep_id long, group_size long, kept boolean")
    digests = stream_digests(
        spark, documents, folder, digest_bytes, trigger or {"availableNow": True}
    )
    # both sides of each join have a shuffle of their own, so that Spark can split a hot digest
    state = stored(
        final_state(spark, stream_state(spark, digests, folder, files_per_batch)), "state"
    )
    rows = spark.read.schema(DIGESTS).parquet(digests)
    grouped = stored(rows.join(state, "digest"), "grouped")

    single = grouped.filter("group_size = 1")
    several = grouped.filter("group_size > 1")
    texts = _located(spark.read.parquet(documents)).select(
        "locator", normalised_bytes()("text").alias("bytes")
    )
    # all texts are shuffled once; clashing digests take theirs from the stored hits
    hits = stored(several.join(texts, "locator"), "hits")
    clashes = stored(
        hits.groupBy("digest")
        .agg(F.min("bytes").alias("least"), F.max("bytes").alias("greatest"))
        .filter("least <> greatest")
        .select("digest"),
        "clashes",
    )
    columns = ["doc_id", "locator", "digest", "keeper", "group_size"]
    same = several.join(clashes, "digest", "left_anti").select(*columns)
    split = hits.join(clashes, "digest", "left_semi").select(
        "doc_id", "locator", "digest", "bytes"
    )
    regrouped = split.join(
        split.groupBy("digest", "bytes").agg(
            F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count("*").alias("group_size")
        ),
        ["digest", "bytes"],
    ).select(*columns)
    return (
        single.select(*columns)
        .unionByName(same)
        .unionByName(regrouped)
        .select(
            "doc_id",
            "locator",
            "digest",
            F.col("keeper.doc_id").alias("keep_id"),
            "group_size",
            (F.col("locator") == F.col("keeper.locator")).alias("kept"),
        )
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; ``docs`` is written to shared storage
    first, as a row needs a place that does not change."""
    spark = docs.sparkSession
    path = shared_folder(spark, "exact-input")
    docs.write.option("compression", "zstd").parquet(path)
    dropped = exact_groups(spark, path).filter("NOT kept").select("locator")
    placed = spark.read.schema(docs.schema).parquet(path)
    located = placed.select(
        F.struct("*").alias("document"),
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
        ).alias("locator"),
    )
    return located.join(dropped, "locator", "left_anti").select("document.*")
