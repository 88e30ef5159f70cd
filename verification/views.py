"""Patron tables derived from the driver's tables.

The texts mean the same to Spark and DuckDB, so both sides of a comparison start
from equal rows. What each view covers is listed in FIXTURES.md; population and
boundaries hold the areas that customers live in.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tractwise import PatronTables

AS_OF = date(2001, 8, 1)

# Tracts of the nations of one region, as a caller would write them.
ASIA_TRACTS = "'381200','381700','382200','382700','383200'"

BASE_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderdate TIMESTAMP_NTZ",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
}

_TRACT = "CAST(381000 + {} * 100 AS VARCHAR(6))"
_COUNTY = "CASE WHEN c_custkey % 50 = 1 THEN '021' ELSE '017' END"
_BLOCK_GROUP = "CAST(1 + c_custkey % 3 AS VARCHAR(1))"

VIEWS = {
    "patron_record": """
SELECT c.c_custkey AS id,
 CASE WHEN c.c_custkey % 41 = 0 THEN NULL ELSE CAST((c.c_custkey * 7919) % 500 AS INT) END AS checkout_total,
 CASE WHEN c.c_custkey % 43 = 0 THEN NULL ELSE CAST((c.c_custkey * 104729) % 200 AS INT) END AS renewal_total,
 CAST((c.c_custkey * 31) % 12 AS INT) AS checkout_count,
 CASE WHEN c.c_custkey % 37 = 0 THEN NULL ELSE DATE '1930-01-01' + CAST((c.c_custkey * 101) % 25000 AS INT) END AS birth_date_gmt,
 o.activity_gmt,
 CASE WHEN c.c_mktsegment = 'MACHINERY' THEN 'b' ELSE '-' END AS mblock_code,
 CAST(CASE WHEN c.c_acctbal < 0 THEN -c.c_acctbal ELSE 0 END AS DECIMAL(12,2)) AS owed_amt
FROM customer c
LEFT JOIN (SELECT o_custkey, MAX(o_orderdate) AS activity_gmt FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) o
ON c.c_custkey = o.o_custkey""",
    "record_metadata": """
SELECT c_custkey AS id,
 CAST(DATE '1998-01-01' + CAST((c_custkey * 7919) % 1300 AS INT) AS TIMESTAMP) AS creation_date_gmt
FROM customer""",
    "patron_record_address": """
SELECT c_custkey AS patron_record_id, '1' AS patron_record_address_type_id FROM customer WHERE c_custkey % 53 <> 0
UNION ALL SELECT c_custkey, '2' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, '1' FROM customer WHERE c_custkey % 47 = 0""",
    "hold": """
SELECT o_orderkey AS id, o_custkey AS patron_record_id FROM orders WHERE o_orderstatus = 'O'""",
    "varfield": f"""
SELECT c_custkey AS record_id, CASE WHEN c_custkey % 23 = 0 THEN 'x' ELSE 'k' END AS varfield_type_code,
 CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 29 = 0 THEN 'unmatched address'
 ELSE '|s25|c' || {_COUNTY} || '|t' || {_TRACT.format("c_nationkey")} || '|b' || {_BLOCK_GROUP} END AS field_content
FROM customer WHERE c_custkey % 19 <> 0
UNION ALL SELECT c_custkey, 'k', '|s25|c017|t' || {_TRACT.format("c_nationkey")} || '|b4' FROM customer WHERE c_custkey % 31 = 0
UNION ALL SELECT c_custkey, 'k', '|s25|c017|t' || {_TRACT.format("c_nationkey")} || '|b4' FROM customer WHERE c_custkey % 62 = 0""",
    "service_area": f"""
SELECT r_name AS library, {_TRACT.format("n_nationkey")} AS tract, r_regionkey
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 24""",
    "customer_tracts": f"""
SELECT r_name AS library, {_TRACT.format("c_nationkey")} AS tract, r_regionkey
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_nationkey <> 24""",
    "population": f"""
SELECT '25' || county || {_TRACT.format("c_nationkey")} || block_group AS geoid,
 'Block Group ' || block_group || ', Census Tract ' || CAST(3810 + c_nationkey AS VARCHAR(4)) || ', ' || n_name AS geographic_area_name,
 CAST(CASE WHEN c_nationkey = 7 AND block_group = '1' THEN 0 ELSE 40 + 2 * COUNT(*) + (c_nationkey * 37) % 61 END AS BIGINT) AS estimated_population,
 COUNT(*) AS households
FROM (SELECT c_nationkey, {_COUNTY} AS county, {_BLOCK_GROUP} AS block_group FROM customer) c
JOIN nation ON c_nationkey = n_nationkey
WHERE NOT (c_nationkey = 6 AND block_group = '2')
GROUP BY county, c_nationkey, block_group, n_name""",
    "boundary": f"""
SELECT geoid, '{{"type":"Polygon","coordinates":[[[' || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || '],[' || x0 || ',' || y0 || ']]]}}' AS geometry_json, NAMELSAD, households
FROM (SELECT '25' || county || {_TRACT.format("c_nationkey")} || block_group AS geoid, 'Block Group ' || block_group AS NAMELSAD, 'about ' || CAST(c_nationkey AS VARCHAR(2)) AS households,
 CAST(-72 + c_nationkey AS VARCHAR(4)) AS x0, CAST(-71 + c_nationkey AS VARCHAR(4)) AS x1,
 CAST(42 + CAST(block_group AS INT) AS VARCHAR(4)) AS y0, CAST(43 + CAST(block_group AS INT) AS VARCHAR(4)) AS y1
 FROM (SELECT c_nationkey, {_COUNTY} AS county, {_BLOCK_GROUP} AS block_group FROM customer
  UNION SELECT c_nationkey, '017', '4' FROM customer WHERE c_custkey % 31 = 0) c
 WHERE NOT (c_nationkey = 11 AND block_group = '3')) g""",
}

#: Lines as files have them, with a column that is not declared.
POPULATION_HEADER = ("geoid", "geographic_area_name", "estimated_population", "households")
LINES = {
    "population_lines": f"""
SELECT geoid || ',"' || geographic_area_name || '",' || CAST(estimated_population AS VARCHAR(20)) || ',' || CAST(households AS VARCHAR(20)) AS value
FROM ({VIEWS["population"]}) p""",
    "boundary_lines": f"""
SELECT '{{"type":"Feature","properties":{{"GEOID":"' || geoid || '","NAMELSAD":"' || NAMELSAD || '","ALAND":' || substr(geoid, 6, 6) || '}},"geometry":' || geometry_json || '}}' AS value
FROM ({VIEWS["boundary"]}) b""",
}
LINES["catalogue_lines"] = f"""
SELECT library || ',"' || string_agg(chr(39) || tract || chr(39), ', ') || '",'
 || CASE WHEN r_regionkey > 0 THEN CAST(r_regionkey + 42.25 AS VARCHAR(8)) || ',' || CAST(-71.5 - r_regionkey AS VARCHAR(8)) || ',11' ELSE ',,' END AS value
FROM ({VIEWS["service_area"]}) s GROUP BY library, r_regionkey"""
#: Lines that cannot be read among those that can, made of the same rows.
LINES["faulty_population_lines"] = f"""
{LINES["population_lines"]}
UNION ALL SELECT geoid || ',few' FROM ({VIEWS["population"]}) a WHERE estimated_population % 5 = 0
UNION ALL SELECT geoid || ',many,1,2,3' FROM ({VIEWS["population"]}) b WHERE estimated_population % 5 = 1
UNION ALL SELECT geoid || ',text,12x,1' FROM ({VIEWS["population"]}) c WHERE estimated_population % 5 = 2
UNION ALL SELECT ',no id,' || CAST(estimated_population AS VARCHAR(20)) || ',1' FROM ({VIEWS["population"]}) d WHERE estimated_population % 5 = 3"""
LINES["faulty_boundary_lines"] = f"""
{LINES["boundary_lines"]}
UNION ALL SELECT geoid || '{{' FROM ({VIEWS["boundary"]}) a WHERE geoid LIKE '%1'
UNION ALL SELECT '{{"type":"Feature","properties":{{"GEOID":"' || geoid || '","ALAND":"wide"}},"geometry":null}}' FROM ({VIEWS["boundary"]}) c WHERE geoid LIKE '%2'
UNION ALL SELECT '{{"type":"Feature","properties":{{"NAMELSAD":"' || geoid || '","ALAND":7}},"geometry":null}}' FROM ({VIEWS["boundary"]}) d WHERE geoid LIKE '%3'"""
VIEWS.update(LINES)

#: The tables of an earlier day: patrons that have come since are missing, some that have gone
#: are there, and figures, dates, addresses, holds and fields differ.
EARLIER = {
    "patron_record": f"""
SELECT id, CASE WHEN id % 7 = 0 THEN checkout_total + 5 ELSE checkout_total END AS checkout_total, renewal_total, checkout_count,
 CASE WHEN id % 14 = 0 THEN DATE '1950-02-28' ELSE birth_date_gmt END AS birth_date_gmt, activity_gmt,
 CASE WHEN id % 21 = 0 THEN 'b' ELSE mblock_code END AS mblock_code, owed_amt
FROM ({VIEWS["patron_record"]}) p WHERE id % 10 <> 3
UNION ALL SELECT -id, checkout_total, renewal_total, checkout_count, birth_date_gmt, activity_gmt, mblock_code, owed_amt
FROM ({VIEWS["patron_record"]}) q WHERE id % 97 = 0 AND id > 0""",
    "record_metadata": f"""
SELECT id, CASE WHEN id % 13 = 0 THEN CAST(DATE '1999-09-09' AS TIMESTAMP) ELSE creation_date_gmt END AS creation_date_gmt
FROM ({VIEWS["record_metadata"]}) m WHERE id % 10 <> 3
UNION ALL SELECT -id, creation_date_gmt FROM ({VIEWS["record_metadata"]}) n WHERE id % 97 = 0 AND id > 0""",
    "patron_record_address": f"""
SELECT * FROM ({VIEWS["patron_record_address"]}) a WHERE patron_record_id % 11 <> 2
UNION ALL SELECT -patron_record_id, patron_record_address_type_id FROM ({VIEWS["patron_record_address"]}) b WHERE patron_record_id % 97 = 0 AND patron_record_id > 0
UNION ALL SELECT patron_record_id, '1' FROM ({VIEWS["patron_record_address"]}) c WHERE patron_record_id % 59 = 0""",
    "hold": f"""
SELECT * FROM ({VIEWS["hold"]}) h WHERE id % 4 <> 1
UNION ALL SELECT -id, patron_record_id FROM ({VIEWS["hold"]}) g WHERE id % 5 = 0 AND id > 0""",
    "varfield": f"""
SELECT record_id, varfield_type_code, CASE WHEN record_id % 9 = 0 THEN replace(field_content, '|b1', '|b2') ELSE field_content END AS field_content
FROM ({VIEWS["varfield"]}) v WHERE record_id % 8 <> 5
UNION ALL SELECT -record_id, varfield_type_code, field_content FROM ({VIEWS["varfield"]}) w WHERE record_id % 97 = 0 AND record_id > 0""",
}

#: The same tables with keys that repeat: patrons and metadata twice, holds under several patrons.
REPEATED = {
    "patron_record": f"""
SELECT * FROM ({VIEWS["patron_record"]}) p
UNION ALL SELECT id, checkout_count, renewal_total, checkout_count, birth_date_gmt, activity_gmt, 'b', owed_amt
FROM ({VIEWS["patron_record"]}) q WHERE id % 13 = 0""",
    "record_metadata": f"""
SELECT * FROM ({VIEWS["record_metadata"]}) m
UNION ALL SELECT id, creation_date_gmt FROM ({VIEWS["record_metadata"]}) n WHERE id % 11 = 0""",
    "hold": """
SELECT o_orderkey - o_orderkey % 64 AS id, o_custkey AS patron_record_id FROM orders WHERE o_orderstatus = 'O'""",
}


def _register(spark: SparkSession, sf_dir: str, texts: list[str]) -> None:
    """Make the base tables that the texts name available to SQL."""
    for base, schema in BASE_SCHEMAS.items():
        if any(re.search(rf"\b{base}\b", text) for text in texts):
            frame = spark.read.schema(schema).parquet(f"{sf_dir}/{base}.parquet")
            frame.createOrReplaceTempView(base)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _register(spark, sf_dir, [VIEWS[name]])
    return spark.sql(VIEWS[name])


def tables(
    spark: SparkSession, sf_dir: str, repeated: bool = False, earlier: bool = False
) -> PatronTables:
    """The five tables. Holds are orders, which have unique keys unless ``repeated``."""
    names = ("patron_record", "patron_record_address", "record_metadata", "hold", "varfield")
    texts = {**VIEWS, **REPEATED} if repeated else {**VIEWS, **EARLIER} if earlier else VIEWS
    _register(spark, sf_dir, [texts[name] for name in names])
    return PatronTables(
        **{name: spark.sql(texts[name]) for name in names}, unique_holds=not repeated
    )


def catalogue(spark: SparkSession, sf_dir: str, source: str = "service_area") -> DataFrame:
    """Tract lists per library; the map view of the first region is unknown."""
    known = F.col("r_regionkey") > 0
    return (
        view(spark, sf_dir, source)
        .groupBy("library", "r_regionkey")
        .agg(F.collect_set("tract").alias("tracts"))
        .select(
            "library",
            "tracts",
            F.when(known, F.col("r_regionkey") + F.lit(42.25)).alias("lat"),
            F.when(known, F.lit(-71.5) - F.col("r_regionkey")).alias("lon"),
            F.when(known, F.lit(11)).alias("zoom"),
        )
    )
