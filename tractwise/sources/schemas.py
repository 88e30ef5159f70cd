"""Schemas of the inputs, with the columns that the statistics read."""

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


PATRON_RECORD = _schema(
    id=T.LongType(),
    checkout_total=T.IntegerType(),
    renewal_total=T.IntegerType(),
    checkout_count=T.IntegerType(),
    birth_date_gmt=T.DateType(),
    activity_gmt=T.TimestampType(),
    mblock_code=T.StringType(),
    owed_amt=T.DecimalType(12, 2),
)
PATRON_RECORD_ADDRESS = _schema(
    patron_record_id=T.LongType(),
    patron_record_address_type_id=T.StringType(),
)
RECORD_METADATA = _schema(id=T.LongType(), creation_date_gmt=T.TimestampType())
HOLD = _schema(id=T.LongType(), patron_record_id=T.LongType())
VARFIELD = _schema(
    record_id=T.LongType(),
    varfield_type_code=T.StringType(),
    field_content=T.StringType(),
)
POPULATION = _schema(
    geoid=T.StringType(),
    geographic_area_name=T.StringType(),
    estimated_population=T.LongType(),
)

# The five tables, and the patron key each is partitioned by.
TABLES = {
    "patron_record": (PATRON_RECORD, "id"),
    "patron_record_address": (PATRON_RECORD_ADDRESS, "patron_record_id"),
    "record_metadata": (RECORD_METADATA, "id"),
    "hold": (HOLD, "patron_record_id"),
    "varfield": (VARFIELD, "record_id"),
}

# Tables whose patron key occurs once.
UNIQUE_KEYS = ("patron_record", "record_metadata")
