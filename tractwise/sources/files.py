"""Population and boundary inputs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StringType

from tractwise.sources.schemas import POPULATION

#: Column that a parser puts a line in which it cannot read.
BROKEN = "_broken_line"


def lower_names(frame: DataFrame) -> DataFrame:
    """The same columns under lower-case names."""
    return frame.toDF(*[name.lower() for name in frame.columns])


def population_columns(raw: DataFrame, tried: bool = False) -> DataFrame:
    """Declared columns of text columns, typed, and all others as they are. A text that is no
    number raises, unless it was ``tried``."""
    declared = POPULATION.fieldNames()

    def typed(name: str, kind: DataType) -> Column:
        return F.col(name).try_cast(kind) if tried else F.col(name).cast(kind)

    return raw.select(
        *[typed(field.name, field.dataType).alias(field.name) for field in POPULATION],
        *[F.col(f"`{name}`") for name in raw.columns if name not in declared],
    )


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """Population CSV with a header. Columns go by name and nothing is inferred,
    so area ids keep their leading zeros. Undeclared columns stay as text."""
    return population_columns(spark.read.option("header", True).csv(path))


def parse_population(lines: DataFrame, names: Iterable[str]) -> DataFrame:
    """``read_population`` of CSV lines (``value``) that have these columns."""
    schema = ", ".join(f"`{name}` STRING" for name in names)
    return population_columns(lines.select(F.from_csv("value", schema).alias("r")).select("r.*"))


def split_population(
    lines: DataFrame, names: Iterable[str]
) -> tuple[DataFrame, DataFrame]:
    """``parse_population`` of the lines that can be read, and the others as (value, reason).

    A line is rejected that has another number of cells, no area id, or text where a number
    is declared. Nothing stops the read, and each line is in exactly one of the two.
    """
    names = list(names)
    schema = ", ".join(f"`{name}` STRING" for name in names)
    cells = F.from_csv(
        "value", f"{schema}, `{BROKEN}` STRING", {"columnNameOfCorruptRecord": BROKEN}
    )
    rows = lines.select("value", cells.alias("r"))
    typed = [field for field in POPULATION if field.dataType != StringType()]
    reasons = [F.when(F.col("r").isNull() | F.col(f"r.{BROKEN}").isNotNull(), "number of cells")]
    reasons.append(F.when(F.coalesce("r.geoid", F.lit("")) == "", "no geoid"))
    for field in typed:
        cell = F.col(f"r.`{field.name}`")
        wrong = cell.isNotNull() & cell.try_cast(field.dataType).isNull()
        reasons.append(F.when(wrong, f"{field.name} is no {field.dataType.simpleString()}"))
    judged = rows.withColumn("reason", F.coalesce(*reasons))
    good = judged.where(F.col("reason").isNull()).select("r.*").drop(BROKEN)
    return population_columns(good, tried=True), _rejected(judged)


def _rejected(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason").isNotNull()).select("value", "reason")


def read_boundary_table(spark: SparkSession, path: str) -> DataFrame:
    """Prepared parquet boundaries: ``geoid``, ``geometry_json`` (EPSG:4326) and
    whatever else the table has."""
    return lower_names(spark.read.parquet(path))


def read_boundary_features(
    spark: SparkSession, path: str, properties: tuple[str, ...] | str | None = None
) -> DataFrame:
    """Boundaries from line-delimited GeoJSON (EPSG:4326), one feature per line.

    Properties become lower-case columns: text columns from a tuple of names, typed ones
    from a schema text such as ``"GEOID STRING, ALAND BIGINT"``. Left out, all properties
    that occur in the file become text columns, for which their names are read first. The
    geometry stays text.
    """
    return parse_boundary_features(spark.read.text(path), properties)


def parse_boundary_features(
    lines: DataFrame, properties: tuple[str, ...] | str | None = None
) -> DataFrame:
    """``read_boundary_features`` of lines (``value``) from any source."""
    text = F.get_json_object("value", "$.properties")
    if properties is None:
        keys = lines.select(F.explode(F.json_object_keys(text)).alias("name")).distinct()
        properties = tuple(row.name for row in keys.orderBy("name").collect())
    if not isinstance(properties, str):
        properties = ", ".join(f"`{name}` STRING" for name in properties)
    names = F.from_json(text, properties)
    return lower_names(
        lines.select(
            names.alias("p"), F.get_json_object("value", "$.geometry").alias("geometry_json")
        ).select("p.*", "geometry_json")
    )


def split_boundary_features(
    lines: DataFrame, properties: str, key: str = "geoid"
) -> tuple[DataFrame, DataFrame]:
    """``parse_boundary_features`` of the lines that can be read, and the others as (value,
    reason).

    ``properties`` is a schema text, and ``key`` the lower-case name of the property that must
    have a value. A line is rejected that is no JSON object with properties, or has a
    property of another type or no key. A feature without geometry is kept.
    """
    text = F.get_json_object("value", "$.properties")
    parsed = F.from_json(
        text, f"{properties}, `{BROKEN}` STRING", {"columnNameOfCorruptRecord": BROKEN}
    )
    rows = lines.select("value", text.alias("t"), parsed.alias("p"))
    fields = [field.name for field in rows.schema["p"].dataType if field.name != BROKEN]
    [owner] = [name for name in fields if name.lower() == key]
    reason = F.coalesce(
        F.when(F.col("t").isNull(), "no feature with properties"),
        F.when(F.col(f"p.{BROKEN}").isNotNull(), "a property has another type"),
        F.when(F.col(f"p.`{owner}`").isNull(), f"no {key}"),
    )
    judged = rows.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull()).select(
        "p.*", F.get_json_object("value", "$.geometry").alias("geometry_json")
    )
    return lower_names(good.drop(BROKEN)), _rejected(judged)


#: Text that every feature of a collection begins with, unless its writer used other blanks.
FEATURE_START = '{"type":"Feature",'


def read_feature_collection(
    spark: SparkSession, path: str, start: str = FEATURE_START
) -> DataFrame:
    """Lines (``value``), one a feature, of files that are parts of a GeoJSON collection.

    Files are split at ``start``, so neither a collection nor a file is ever held as a whole;
    tasks share a large file. What follows a feature, a comma or the end of the collection,
    stays behind it; JSON functions read up to the end of the feature. Quotes in a property
    are escaped, so ``start`` occurs in none; features inside properties are not supported.
    """
    records = spark.read.option("lineSep", start).text(path)
    # what stands before the first feature of a file: a head, a comma, the end, or nothing
    before = F.col("value").rlike(r'^[\s,\]}]*$|^\s*\{[^{]*"features"\s*:\s*\[\s*$')
    return records.where(~before).select(F.concat(F.lit(start), "value").alias("value"))
