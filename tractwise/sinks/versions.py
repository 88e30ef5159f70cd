"""Outputs that change all at once: a folder a run, and one pointer row a library, written last.

Below a root every output has a folder ``<output>/version=<v>`` for each run, with one
``part=<hash of the library>`` in it for each library. ``pointers`` holds one small file a run:
which version of which output is the valid one of a library (and day). Readers take the
latest pointer and read no other version, so

- a run that fails before its pointer file leaves everything as it was, for all outputs,
- a run that gets there replaces all its outputs together, also those without rows,
- readers of an older version are not disturbed before that version is swept.

The pointer file is written by one task; Spark's commit makes it visible by one rename. What
a run has replaced is emptied afterwards (``sweep``); if that fails, it is only space.

All of it is DataFrame reads and writes, so it works wherever Spark can read and write.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from datetime import date, datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window, functions as F
from pyspark.sql import types as T

POINTERS = "output STRING, library STRING, run_date DATE, version STRING, part STRING"


def new_version() -> str:
    """A name that no other run has; names sort by time."""
    moment = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    return f"{moment}-{uuid.uuid4().hex[:12]}"


def part_of(library: Column) -> Column:
    """Folder name of a library: a hash, as a name may have signs that paths do not. It starts
    with a letter, so it is never taken for a number."""
    return F.concat(F.lit("p"), F.sha1(library.cast("binary")))


def version_path(root: str, output: str, version: str) -> str:
    return f"{root.rstrip('/')}/{output}/version={version}"


def write_version(
    frame: DataFrame, root: str, output: str, version: str, form: str = "parquet"
) -> None:
    """Write the rows of one run; they are not valid before ``point``.

    Rebalancing gives each library few, even files and still splits one that is much
    larger than the others.
    """
    rows = frame.withColumn("part", part_of(F.col("library")))
    if form == "text":
        rows = rows.select("part", "value")
    (
        rows.hint("rebalance", "part")
        .write.mode("errorifexists")
        .partitionBy("part")
        .format(form)
        .save(version_path(root, output, version))
    )


def _loaded(reader: DataFrameReader, path: str) -> DataFrame | None:
    """What a path has, None if it does not exist."""
    try:
        return reader.load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    reader = spark.read.schema(POINTERS).format("json")
    found = _loaded(reader, f"{root.rstrip('/')}/pointers")
    return spark.createDataFrame([], POINTERS) if found is None else found


def valid(spark: SparkSession, root: str) -> DataFrame:
    """The latest pointer of every output, library and day; a few rows a library."""
    latest = Window.partitionBy("output", "library", "run_date").orderBy(F.desc("version"))
    return (
        _pointers(spark, root)
        .withColumn("place", F.row_number().over(latest))
        .where(F.col("place") == 1)
        .drop("place")
    )


def published_versions(spark: SparkSession, root: str, output: str) -> list:
    """The valid versions of an output, oldest first; a row a version."""
    found = valid(spark, root).where(F.col("output") == output).select("version").distinct()
    rows = found.orderBy("version").collect()
    if not rows:
        raise ValueError(f"{output} has never been published below {root}")
    return rows


def point(
    spark: SparkSession,
    root: str,
    version: str,
    outputs: dict[str, date | None],
    libraries: Iterable[str] | Mapping[str, Iterable[str]],
) -> None:
    """Make a version the valid one of all these outputs and libraries, in one file.

    ``outputs`` gives the day of dated outputs and None for the others; ``libraries`` may
    differ by output.
    """
    if not isinstance(libraries, Mapping):
        libraries = dict.fromkeys(outputs, sorted(set(libraries)))
    rows = [
        (output, library, day, version)
        for output, day in outputs.items()
        for library in sorted(set(libraries[output]))
    ]
    kind = "output STRING, library STRING, run_date DATE, version STRING"
    frame = spark.createDataFrame(rows, kind).withColumn("part", part_of(F.col("library")))
    frame.coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/pointers")


def read_published(
    spark: SparkSession,
    root: str,
    output: str,
    schema: T.StructType | str | None = None,
    form: str = "parquet",
) -> DataFrame:
    """Valid rows of an output, with ``run_date`` if it is dated.

    Only versions that are valid for some library are read, and of these only the folders of
    their libraries. Text has ``library`` and ``value``. Without a schema Parquet has that of
    its files, of which there must be some; ValueError if it was never published.
    """
    pointers = valid(spark, root).where(F.col("output") == output)
    known = pointers.agg(
        F.sort_array(F.collect_set("version")).alias("versions"),
        F.coalesce(F.bool_or(F.col("run_date").isNotNull()), F.lit(False)).alias("dated"),
    ).first()
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if form == "text":
        schema = None
    elif schema is None and not known.versions:
        raise ValueError(f"{output} has never been published below {root}")
    reader = spark.read.option("basePath", f"{root.rstrip('/')}/{output}").format(form)
    if schema is not None:
        folders = [T.StructField(name, T.StringType()) for name in ("version", "part")]
        schema = T.StructType([*schema.fields, *folders])
        reader = reader.schema(schema)
    if known.versions:
        rows = reader.load([version_path(root, output, version) for version in known.versions])
    else:
        rows = spark.createDataFrame([], schema or "value STRING, version STRING, part STRING")
    for name in {"version", "part"} - set(rows.columns):
        # no folder to take it from: text of runs without any row
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    keys = pointers.select(
        "version", "part", F.col("library").alias("owner"), F.col("run_date").alias("day")
    )
    columns = [F.col(f"`{name}`") for name in rows.columns if name not in ("version", "part")]
    if form == "text":
        columns = [F.col("owner").alias("library"), *columns]
    if known.dated:
        columns.append(F.col("day").alias("run_date"))
    return rows.join(keys, ["version", "part"]).select(*columns)


def sweep(spark: SparkSession, root: str) -> int:
    """Empty what no pointer makes valid any more; returns the number of emptied folders.

    A version that is replaced as a whole is emptied at once, else library by library.
    Folders stay, as Spark's writer cannot remove one, but hold no data. A version without
    any pointer is left alone: its run may still be writing.
    """
    keys = ["output", "version", "part"]
    kept = valid(spark, root).select(*keys).distinct()
    in_use = kept.select("output", "version").distinct().withColumn("in_use", F.lit(True))
    old = (
        _pointers(spark, root)
        .select(*keys)
        .distinct()
        .join(kept, keys, "left_anti")
        .join(in_use, ["output", "version"], "left")
    )
    # as many rows as libraries of runs that were replaced
    paths = set()
    for row in old.collect():
        path = version_path(root, row.output, row.version)
        paths.add(f"{path}/part={row.part}" if row.in_use else path)
    nothing = spark.createDataFrame([], "part STRING, value STRING")
    emptied = 0
    for path in sorted(paths):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        found = _loaded(files, path)
        if found is None or found.select("path").isEmpty():
            continue
        # a partitioned writer makes no file without rows
        writer = nothing.write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.partitionBy("part").text(path)
        emptied += 1
    return emptied
