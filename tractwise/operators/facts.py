"""Per-patron inputs of the statistics, each reduced to one row per patron.

Sums run over the joined rows: a patron counts once per address, census field and
hold. Instead of building those rows, every table is counted per patron, and the
product of the counts weighs the patron's figures. All but the patron's own
columns are dropped or turned into flags before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tractwise.functions import fixed, patrons


def patron_measures(patron_record: DataFrame, as_of: Column) -> DataFrame:
    """Circulation figures, age and flags per patron."""
    return patron_record.select(
        "id",
        "checkout_total",
        "renewal_total",
        (F.col("checkout_total") + F.col("renewal_total")).alias("circ"),
        "checkout_count",
        patrons.age_in_years(F.col("birth_date_gmt"), as_of).alias("age"),
        patrons.within_last_year(F.col("activity_gmt"), as_of).alias("is_active"),
        patrons.is_blocked(F.col("mblock_code"), F.col("owed_amt")).alias("is_blocked"),
    )


def patron_creation(record_metadata: DataFrame, as_of: Column) -> DataFrame:
    """Whether the record was created in the last year."""
    return record_metadata.select(
        "id", patrons.within_last_year(F.col("creation_date_gmt"), as_of).alias("is_new")
    )


def summed_measures(patron_record: DataFrame, as_of: Column) -> DataFrame:
    """``patron_measures`` with one row per patron key, however often a key occurs.

    ``known_ages`` is the number of rows whose age is known; flags hold if any row's does.
    """
    rows = patron_measures(patron_record, as_of)
    figures = ("checkout_total", "renewal_total", "circ", "checkout_count", "age")
    return rows.groupBy("id").agg(
        *[F.sum(name).alias(name) for name in figures],
        F.count("age").alias("known_ages"),
        F.bool_or("is_active").alias("is_active"),
        F.bool_or("is_blocked").alias("is_blocked"),
    )


def summed_creation(record_metadata: DataFrame, as_of: Column) -> DataFrame:
    """``patron_creation`` with one row per key and ``creations``, the rows of the key."""
    return (
        patron_creation(record_metadata, as_of)
        .groupBy("id")
        .agg(F.count("*").alias("creations"), F.bool_or("is_new").alias("is_new"))
    )


def mailing_addresses(patron_record_address: DataFrame) -> DataFrame:
    """Patron key of every address of the counted type."""
    return patron_record_address.where(
        F.col("patron_record_address_type_id") == fixed.MAILING_ADDRESS_TYPE
    ).select(F.col("patron_record_id").alias("id"))


def address_counts(patron_record_address: DataFrame) -> DataFrame:
    """Addresses of the counted type per patron."""
    return (
        mailing_addresses(patron_record_address)
        .groupBy("id")
        .agg(F.count("*").alias("addresses"))
    )


def hold_counts(hold: DataFrame, unique: bool = False) -> DataFrame:
    """Hold rows and distinct holds per patron.

    Spark spreads the distinct count over (patron, hold) before it gathers
    patrons, so one patron with a large share of all holds is no hot task. That
    takes two shuffles of all holds; where the caller knows hold ids to be unique,
    plain counts take one, of already counted rows.
    """
    holds = hold.select(F.col("patron_record_id").alias("id"), F.col("id").alias("hold_id"))
    distinct = F.count("hold_id") if unique else F.count_distinct("hold_id")
    return holds.groupBy("id").agg(
        F.count("*").alias("holds"), distinct.alias("distinct_holds")
    )


def frequent_patrons(hold: DataFrame, share: int = 256) -> DataFrame:
    """(id, parts) of patrons with more than one in ``share`` of all holds, by a sketch.

    A frequent-items sketch of bounded size runs over the holds. No more than ``share``
    patrons can be so frequent, so the result has at most that many rows. Parts are such
    that each has about one in ``share`` of all holds; the sketch's error only makes parts
    somewhat larger or smaller.
    """
    sketch = hold.agg(
        F.expr(f"approx_top_k(patron_record_id, {share}, {64 * share})").alias("top"),
        F.count("patron_record_id").alias("total"),
    )
    return (
        sketch.select("total", F.inline("top"))
        .where((F.col("count") * share > F.col("total")) & F.col("item").isNotNull())
        .select(
            F.col("item").alias("id"),
            F.ceil(F.col("count") * share / F.col("total")).cast("int").alias("parts"),
        )
    )


def hold_parts(hold: DataFrame, frequent: DataFrame) -> DataFrame:
    """Known holds of known patrons, those of frequent patrons dealt over parts by hold."""
    return (
        hold.where(F.col("id").isNotNull())
        .select(F.col("patron_record_id").alias("id"), F.col("id").alias("hold_id"))
        .join(frequent, "id", "left")
        .select(
            "id",
            "hold_id",
            F.pmod(F.hash("hold_id"), F.coalesce("parts", F.lit(1))).alias("part"),
        )
    )
