"""The five patron tables as a bundle of DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tractwise.sources.jdbc import jdbc_ranges, jdbc_reader, key_predicates
from tractwise.sources.schemas import TABLES, UNIQUE_KEYS


@dataclass(frozen=True)
class PatronTables:
    """Inputs of the statistics. Any reader will do as long as the columns fit.

    Set ``unique_holds`` where ``hold.id`` is a key: it saves a shuffle of all holds.
    """

    patron_record: DataFrame
    patron_record_address: DataFrame
    record_metadata: DataFrame
    hold: DataFrame
    varfield: DataFrame
    unique_holds: bool = False

    def of_patrons(self, patrons: DataFrame) -> PatronTables:
        """The rows of some patrons (``id``). ``varfield`` stays whole."""
        few = patrons.select(F.col("id").alias("few_id")).distinct()
        kept = {
            name: frame.join(few, frame[TABLES[name][1]] == F.col("few_id"), "left_semi")
            for name, frame in (
                ("patron_record", self.patron_record),
                ("patron_record_address", self.patron_record_address),
                ("record_metadata", self.record_metadata),
                ("hold", self.hold),
            )
        }
        return replace(self, **kept)


def parquet_tables(
    spark: SparkSession, root: str, unique_holds: bool = False
) -> PatronTables:
    """Read ``root/<table>`` parquet directories under the declared schemas."""
    return PatronTables(
        **{
            name: spark.read.schema(schema).parquet(f"{root}/{name}")
            for name, (schema, _) in TABLES.items()
        },
        unique_holds=unique_holds,
    )


def catalog_tables(
    spark: SparkSession, database: str, unique_holds: bool = False
) -> PatronTables:
    """Read the tables of a catalog database, for example bucketed ones."""
    return PatronTables(
        **{
            name: spark.table(f"{database}.{name}").select(*schema.fieldNames())
            for name, (schema, _) in TABLES.items()
        },
        unique_holds=unique_holds,
    )


def jdbc_tables(
    spark: SparkSession,
    url: str,
    schema_name: str,
    bounds: Mapping[str, tuple[int, int]],
    num_partitions: int,
    partition_columns: Mapping[str, str] | None = None,
    unique_holds: bool = False,
    cuts: Mapping[str, list[int]] | None = None,
    **options: str,
) -> PatronTables:
    """Read the tables from PostgreSQL in ``num_partitions`` ranges each.

    Holds are cut by their own ``id``, so one patron's holds are not one range; the
    other tables by patron, unless ``partition_columns`` names another column, which
    need not be one of the columns read. ``bounds`` gives the lowest and highest value
    of that column per table. They only set the stride: rows outside still fall into
    the first and last range. A table with ``cuts`` (see ``jdbc.key_cuts``) is read in ranges
    between these instead, and needs no bounds.
    """
    columns = {"hold": "id", **(partition_columns or {})}
    frames = {}
    for name, (schema, key) in TABLES.items():
        if name in (cuts or {}):
            ranges = key_predicates(columns.get(name, key), cuts[name])
            frame = jdbc_ranges(spark, url, f"{schema_name}.{name}", ranges, **options)
            frames[name] = frame.select(*schema.fieldNames())
            continue
        reader = jdbc_reader(
            spark,
            url,
            f"{schema_name}.{name}",
            columns.get(name, key),
            bounds[name],
            num_partitions,
            **options,
        )
        frames[name] = reader.load().select(*schema.fieldNames())
    return PatronTables(**frames, unique_holds=unique_holds)


def save_bucketed(tables: PatronTables, database: str, buckets: int) -> None:
    """Store the tables in a catalog database, unique keys bucketed.

    Reports then join patrons and their metadata without shuffling either. Run them
    with ``spark.sql.shuffle.partitions`` set to the number of buckets; any other
    number makes Spark shuffle the counted addresses and holds a second time. The
    other tables may hold very many rows of one patron, which bucketing would put
    into one task; they stay unbucketed and are counted before they are shuffled.
    """
    for name, (schema, key) in TABLES.items():
        frame = getattr(tables, name).select(*schema.fieldNames())
        writer = frame.write.mode("overwrite").format("parquet")
        if name in UNIQUE_KEYS:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{database}.{name}")
