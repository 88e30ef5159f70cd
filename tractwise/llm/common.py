"""What several operators share: tables, shared storage, row-wise Arrow maps, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but blanks, tabs and line ends.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
BYTE_WORDS = re.compile(WORD.encode("ascii"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text in one Arrow batch, so that a worker's memory does not follow the row count.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, which driver and executors share.

    Only a session on one machine, where that is unset, gets a temporary folder; elsewhere
    ValueError is raised, as executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to storage that all executors share")
        root = f"file://{tempfile.gettempdir()}/tractwise"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a frame to shared storage and go on from the files: lineage ends here, and
    a lost executor costs no earlier stage."""
    spark = frame.sparkSession
    path = shared_folder(spark, name)
    frame.write.option("compression", compression).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def map_arrow(
    frame: DataFrame,
    schema: str,
    make: Callable[[], Callable[[list[list]], list[list]]],
) -> DataFrame:
    """Apply a function on columns (lists of Python values) batch by batch.

    ``make`` runs once a task and returns the function. Batches are bounded in bytes.
    """
    spark = frame.sparkSession
    bounded_batches(spark)
    kind = frame.sparkSession.createDataFrame([], schema).schema
    names = kind.fieldNames()
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            columns = apply([column.to_pylist() for column in batch.columns])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, arrow.field(n).type) for c, n in zip(columns, names, strict=True)],
                schema=arrow,
            )

    return frame.mapInArrow(run, kind)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes where the session has not done so."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def ascii_lower(column: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def remainder(column: Column, divisor: int) -> Column:
    """crc32 of a number written as text, modulo ``divisor``; NULL counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` any number of times.

    Catalyst may copy an expression into each place that refers to it, also into
    lambdas that run once per element. A lambda's own argument is never copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
