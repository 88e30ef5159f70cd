"""Scalar rules, case by case."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tractwise.functions import codes, fixed, labels, numbers, patrons


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def text(content):
    return F.lit(content).cast("string")


def day(content):
    return F.lit(content).cast("date")


@pytest.mark.parametrize(
    "field, expected",
    [
        ("|s25|c017|t383101|b1", "250173831011"),
        ("|s25|c017", "25017"),
        ("||ss", "|s"),
        ("25|x7", "25|x7"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_code(spark, field, expected):
    assert value(spark, codes.clean_code(text(field))) == expected


def test_tract_and_area(spark):
    code = F.lit("250173831011")
    assert value(spark, codes.tract_of(code)) == "383101"
    levels = {level: value(spark, codes.area_of(code, level)) for level in fixed.LEVELS}
    assert levels == {
        "state": "25",
        "county": "25017",
        "tract": "25017383101",
        "block_group": "250173831011",
    }


def test_unknown_level():
    with pytest.raises(ValueError, match="level must be one of"):
        codes.level_length("village")


@pytest.mark.parametrize(
    "field, area, url",
    [
        (None, "no data", "na"),
        ("", "", "na"),
        ("|s25|c017|t383101|b1", "250173831011", "https://censusreporter.org/profiles/15000US250173831011"),
    ],
)
def test_geoid_and_url(spark, field, area, url):
    assert value(spark, codes.geoid(text(field))) == area
    assert value(spark, codes.census_url(text(field))) == url


def test_url_by_level_column(spark):
    frame = spark.createDataFrame([("state", "25"), ("tract", "25017383101")], "level STRING, area STRING")
    urls = frame.select(codes.profile_url_at(F.col("area"), F.col("level")).alias("u")).collect()
    assert [row["u"].rsplit("/", 1)[1] for row in urls] == ["04000US25", "14000US25017383101"]


@pytest.mark.parametrize(
    "field, expected",
    [("|s25|c017", True), ("unmatched address", False), ("", False), ("|sx5", False), ("x|s25", False), (None, None)],
)
def test_census_field_match(spark, field, expected):
    assert value(spark, codes.has_census_code(text(field))) is expected


@pytest.mark.parametrize(
    "birth, today, expected",
    [
        ("2000-02-29", "2023-02-28", 22),
        ("2000-02-29", "2023-03-01", 23),
        ("2020-06-01", "2020-01-01", 0),
        ("2020-06-01", "2018-01-01", -2),
        (None, "2020-01-01", None),
    ],
)
def test_age(spark, birth, today, expected):
    assert value(spark, patrons.age_in_years(day(birth), day(today))) == expected


@pytest.mark.parametrize(
    "moment, expected",
    [(datetime(2023, 2, 28), True), (datetime(2023, 2, 27, 23, 59), False), (None, None)],
)
def test_last_year_starts_inclusive(spark, moment, expected):
    column = F.lit(moment).cast("timestamp")
    assert value(spark, patrons.within_last_year(column, day("2024-02-29"))) is expected


def test_as_of_date(spark):
    assert value(spark, patrons.as_of_date("2024-02-29")) == date(2024, 2, 29)
    assert value(spark, patrons.as_of_date(F.lit(datetime(2024, 2, 29, 5)))) == date(2024, 2, 29)
    assert value(spark, patrons.as_of_date() == F.current_date()) is True


@pytest.mark.parametrize(
    "code, owed, expected",
    [
        ("-", 0, False),
        ("b", 0, True),
        ("-", 10, True),
        (None, 12, True),
        (None, 0, None),
        ("-", None, None),
        ("b", None, True),
    ],
)
def test_blocked(spark, code, owed, expected):
    owed = F.lit(None if owed is None else Decimal(owed)).cast("decimal(12,2)")
    assert value(spark, patrons.is_blocked(text(code), owed)) is expected


@pytest.mark.parametrize("part, whole, expected", [(3, 7, "42.86"), (1, 2, "50.00"), (1, 800, "0.13"), (0, 3, "0.00")])
def test_percent_text(spark, part, whole, expected):
    assert value(spark, numbers.percent_text(F.lit(part), F.lit(whole))) == expected


@pytest.mark.parametrize("total, count, expected", [(10, 4, "2.50"), (1, 200, "0.01"), (2**62, 3, "1537228672809129301.33")])
def test_ratio_text(spark, total, count, expected):
    assert value(spark, numbers.ratio_text(F.lit(total).cast("bigint"), F.lit(count))) == expected


@pytest.mark.parametrize("total, count, expected", [(5, 2, 2.0), (7, 2, 4.0), (8, 3, 3.0), (None, None, None)])
def test_whole_mean(spark, total, count, expected):
    total, count = F.lit(total).cast("bigint"), F.lit(count).cast("bigint")
    assert value(spark, numbers.whole_mean(total, count)) == expected


def test_two_decimals(spark):
    assert value(spark, numbers.two_decimals(F.lit(1.015))) == 1.01


def test_cardholder_percent(spark):
    assert value(spark, numbers.cardholder_percent(F.lit(1), F.lit(3))) == 33.33
    assert value(spark, numbers.cardholder_percent(F.lit(5), F.lit(0))) is None


@pytest.mark.parametrize(
    "number", [0.0, 0.01, 12.0, 12.5, 12.34, 100.0, 9999999.99, 12345678.0, 1234567890.5]
)
def test_two_decimal_text_reads_like_python(spark, number):
    assert value(spark, numbers.two_decimal_text(F.lit(number))) == str(number)


def test_label(spark):
    row = spark.createDataFrame([("Group 1", 12.5, 7, 40)], "geographic_area_name STRING, pct_cardholders DOUBLE,"
                                " total_patrons BIGINT, estimated_population BIGINT")
    label = row.select(labels.render(fixed.DUAL_CARDHOLDER_LABEL).alias("v")).first()["v"]
    assert label == "<b>Group 1</b><br>12.5%</b><br>Patron Total: 7</b><br>Est. Pop: 40<extra></extra>"


# Patrons, active patrons and percentage of sixteen tracts.
SAMPLE = [
    (2998, 1469, "49.00"), (2809, 1450, "51.62"), (2739, 1331, "48.59"), (2440, 1105, "45.29"),
    (2433, 1093, "44.92"), (2190, 657, "30.00"), (2168, 914, "42.16"), (1713, 603, "35.20"),
    (1699, 452, "26.60"), (1456, 471, "32.35"), (1421, 737, "51.86"), (1371, 297, "21.66"),
    (1198, 507, "42.32"), (1193, 392, "32.86"), (1001, 448, "44.76"), (639, 305, "47.73"),
]


def test_sample_percentages(spark):
    frame = spark.createDataFrame(SAMPLE, "patrons INT, active INT, expected STRING")
    percent = numbers.percent_text(F.col("active"), F.col("patrons"))
    assert frame.where(percent != F.col("expected")).count() == 0
