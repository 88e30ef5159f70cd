"""Expected result of every query as SQL for DuckDB over the driver's tables.

Statistics come from the joined rows, so they do not share the weighting of the
Spark plans.
"""

from __future__ import annotations

from verification.queries import MIN_PATRONS
from verification.views import AS_OF, ASIA_TRACTS, REPEATED, VIEWS

# Fixed values, written out here so that an error in the package does not pass.
_LEVEL_CODES = (
    ("state", 2, "04000US"),
    ("county", 5, "05000US"),
    ("tract", 11, "14000US"),
    ("block_group", 12, "15000US"),
)
_METRIC_ORDER = (
    "total_patrons",
    "estimated_population",
    "pct_cardholders",
    "total_checkouts",
    "checkouts_per_patron",
    "total_new_patrons",
    "total_active_patrons",
    "pct_active",
    "total_blocked_patrons",
    "pct_blocked",
)

_TODAY = f"DATE '{AS_OF}'"
_CLEAN = "regexp_replace(field_content, '[|][sctb]', '', 'g')"
_MATCH = r"regexp_matches(field_content, '^[|]s\d{2}')"
_AGE = f"CAST(date_part('year', age(CAST({_TODAY} AS TIMESTAMP), CAST(birth_date_gmt AS TIMESTAMP))) AS INT)"
_LAST_YEAR = f"CAST({_TODAY} - INTERVAL 1 YEAR AS DATE)"
_ACTIVE = f"CAST(activity_gmt AS DATE) >= {_LAST_YEAR}"
_NEW = f"CAST(creation_date_gmt AS DATE) >= {_LAST_YEAR}"
_BLOCKED = "(mblock_code <> '-' OR owed_amt >= 10)"

_CENSUS = f"""
SELECT record_id AS id, {_CLEAN} AS code FROM varfield
WHERE varfield_type_code = 'k' AND {_MATCH}"""
_STEPS = {
    "census": _CENSUS,
    "mailing": "SELECT patron_record_id AS id FROM patron_record_address WHERE patron_record_address_type_id = '1'",
    "held": "SELECT patron_record_id AS id, id AS hold_id FROM hold",
    "joined": (
        "SELECT *, substr(code, 6, 6) AS tract FROM census JOIN patron_record USING (id)"
        " JOIN mailing USING (id) JOIN record_metadata USING (id) LEFT JOIN held USING (id)"
    ),
}


def _with(query: str, **more: str) -> str:
    steps = {**VIEWS, **_STEPS, **more}
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in steps.items()) + "\n" + query


def _hundredths(value: str) -> str:
    return f"printf('%d.%02d', {value} // 100, {value} % 100)"


def _percent(part: str) -> str:
    return _hundredths(f"((20000 * {part} + total_patrons) // (2 * total_patrons))")


def _stats(rows: str, keys: str, geoid: str, prefix: str, having: str = "") -> str:
    """Aggregate ``rows``; ``keys`` is a list of columns, each with a comma."""
    return f"""
SELECT {keys} geoid, total_patrons, total_checkouts, total_renewals, total_circ, total_checkouts_current,
 total_holds_current, avg_age, total_new_patrons, total_active_patrons,
 {_percent("total_active_patrons")} AS pct_active, total_blocked_patrons,
 {_percent("total_blocked_patrons")} AS pct_blocked,
 {_hundredths("((200 * total_checkouts + total_patrons) // (2 * total_patrons))")} AS checkouts_per_patron,
 'https://censusreporter.org/profiles/' || {prefix} || geoid AS census_reporter_url
FROM (SELECT {keys} {geoid} AS geoid,
  COUNT(DISTINCT id) AS total_patrons,
  CAST(SUM(checkout_total) AS BIGINT) AS total_checkouts,
  CAST(SUM(renewal_total) AS BIGINT) AS total_renewals,
  CAST(SUM(checkout_total + renewal_total) AS BIGINT) AS total_circ,
  CAST(SUM(checkout_count) AS BIGINT) AS total_checkouts_current,
  COUNT(DISTINCT hold_id) AS total_holds_current,
  round_even(AVG({_AGE}), 0) AS avg_age,
  COUNT(DISTINCT CASE WHEN {_NEW} THEN id END) AS total_new_patrons,
  COUNT(DISTINCT CASE WHEN {_ACTIVE} THEN id END) AS total_active_patrons,
  COUNT(DISTINCT CASE WHEN {_BLOCKED} THEN id END) AS total_blocked_patrons
 FROM {rows} GROUP BY ALL {having}) t"""


_ASIA = f"(SELECT * FROM joined WHERE tract IN ({ASIA_TRACTS})) r"
_SERVED = "(SELECT joined.*, library FROM joined JOIN service_area USING (tract)) r"
_LEVELS = (
    "(SELECT {rows}.*, level, digits, prefix FROM {rows} CROSS JOIN (VALUES "
    + ", ".join(f"('{level}', {digits}, '{prefix}')" for level, digits, prefix in _LEVEL_CODES)
    + ") l(level, digits, prefix)) r"
)
_LIBRARY_STATS = _stats(_SERVED, "library,", "substr(code, 1, 12)", "'15000US'")
_PERCENT_OF_POPULATION = (
    "round_even(CAST(total_patrons AS DOUBLE) / CAST(NULLIF(estimated_population, 0) AS DOUBLE)"
    " * 1e2 * 100, 0) / 100"
)
_LAYER = {
    "stats": _LIBRARY_STATS,
    "valued": f"SELECT *, {_PERCENT_OF_POPULATION} AS pct_cardholders FROM stats JOIN population USING (geoid)",
    "layer": "SELECT valued.*, NAMELSAD AS namelsad, boundary.households AS households_boundary, geometry_json FROM valued JOIN boundary USING (geoid)",
    "map_view": (
        "SELECT DISTINCT library, CASE WHEN r_regionkey > 0 THEN CAST(r_regionkey + 42.25 AS DOUBLE) END AS lat,"
        " CASE WHEN r_regionkey > 0 THEN CAST(-71.5 - r_regionkey AS DOUBLE) END AS lon,"
        " CASE WHEN r_regionkey > 0 THEN 11 END AS zoom FROM customer_tracts"
    ),
}
_PERCENT_TEXT = "regexp_replace(CAST(CAST(pct_cardholders AS DECIMAL(20,2)) AS VARCHAR), '0$', '')"
_CARDHOLDER_LABEL = (
    f"'<b>' || geographic_area_name || '</b><br>Cardholder %: ' || {_PERCENT_TEXT}"
    " || '%</b><br>Patron Total: ' || total_patrons || '</b><br>Est. Pop: ' || estimated_population"
    " || '</b><br>Total checkouts: ' || total_checkouts || '</b><br>Active Patron %: ' || pct_active"
    " || '%</b><br>Blocked Patron %: ' || pct_blocked || '%<extra></extra>'"
)
_LEFT_LABEL = (
    f"'<b>' || geographic_area_name || '</b><br>' || {_PERCENT_TEXT}"
    " || '%</b><br>Patron Total: ' || total_patrons || '</b><br>Est. Pop: ' || estimated_population"
    " || '<extra></extra>'"
)
_RIGHT_LABEL = (
    "'<b>' || geographic_area_name || '</b><br>' || pct_active || '%</b><br>Patron Total: ' || total_patrons"
    " || '</b><br>Active Patron Total: ' || total_active_patrons || '</b><br><extra></extra>'"
)
_LONG = "\nUNION ALL ".join(
    f"SELECT library, geoid, geographic_area_name, '{name}' AS metric, CAST({order} AS INT) AS metric_order,"
    f" {'TRUE' if order == 1 else 'FALSE'} AS is_default,"
    f" {_PERCENT_TEXT if name == 'pct_cardholders' else f'CAST({name} AS VARCHAR)'} AS value_text FROM layer"
    for order, name in enumerate(_METRIC_ORDER, 1)
)
_METRICS = f"""
SELECT *, CAST(value_text AS DOUBLE) AS value,
 '<b>' || geographic_area_name || '</b><br>Total: ' || value_text || '<extra></extra>' AS label
FROM ({_LONG}) m"""
# Properties of a feature, in order.
_PROPERTIES = (
    "geoid",
    "total_patrons",
    "total_checkouts",
    "total_renewals",
    "total_circ",
    "total_checkouts_current",
    "total_holds_current",
    "avg_age",
    "total_new_patrons",
    "total_active_patrons",
    "pct_active",
    "total_blocked_patrons",
    "pct_blocked",
    "checkouts_per_patron",
    "census_reporter_url",
    "geographic_area_name",
    "estimated_population",
    "households",
    "pct_cardholders",
    "namelsad",
    "households_boundary",
)


def _level_stats(level: str) -> str:
    [(digits, prefix)] = [rest for name, *rest in _LEVEL_CODES if name == level]
    return _with(_stats("joined", "", f"substr(code, 1, {digits})", f"'{prefix}'"))


ORACLE: dict[str, str] = {
    "population_scan": _with("SELECT * FROM population"),
    "boundary_scan": _with("SELECT geoid, geometry_json, NAMELSAD AS namelsad, households FROM boundary"),
    "population_lines": _with(
        "SELECT geoid, geographic_area_name, estimated_population, CAST(households AS VARCHAR) AS households FROM population"
    ),
    "boundary_lines": _with(
        "SELECT geoid, NAMELSAD AS namelsad, CAST(substr(geoid, 6, 6) AS BIGINT) AS aland, geometry_json FROM boundary"
    ),
    "population_kept": _with(
        "SELECT geoid, geographic_area_name, estimated_population, CAST(households AS VARCHAR) AS households FROM population"
    ),
    "population_rejected": _with(
        "SELECT geoid || ',few' AS value, 'number of cells' AS reason FROM population WHERE estimated_population % 5 = 0"
        " UNION ALL SELECT geoid || ',many,1,2,3', 'number of cells' FROM population WHERE estimated_population % 5 = 1"
        " UNION ALL SELECT geoid || ',text,12x,1', 'estimated_population is no bigint' FROM population"
        " WHERE estimated_population % 5 = 2"
        " UNION ALL SELECT ',no id,' || estimated_population || ',1', 'no geoid' FROM population"
        " WHERE estimated_population % 5 = 3"
    ),
    "boundary_kept": _with(
        "SELECT geoid, NAMELSAD AS namelsad, CAST(substr(geoid, 6, 6) AS BIGINT) AS aland, geometry_json FROM boundary"
    ),
    "boundary_rejected": _with(
        "SELECT geoid || '{' AS value, 'no feature with properties' AS reason FROM boundary WHERE geoid LIKE '%1'"
        """ UNION ALL SELECT '{"type":"Feature","properties":{"GEOID":"' || geoid || '","ALAND":"wide"},"geometry":null}',"""
        " 'a property has another type' FROM boundary WHERE geoid LIKE '%2'"
        """ UNION ALL SELECT '{"type":"Feature","properties":{"NAMELSAD":"' || geoid || '","ALAND":7},"geometry":null}',"""
        " 'no geoid' FROM boundary WHERE geoid LIKE '%3'"
    ),
    "catalogue_lines": _with(
        "SELECT library, tract, lat, lon, zoom FROM service_area JOIN map_view USING (library)", **_LAYER
    ),
    "catalogue_problems": _with(
        "SELECT 'shared' AS problem, library, tract, coalesce(fields, 0) AS fields FROM moved LEFT JOIN named USING (tract)"
        " WHERE tract IN (SELECT tract FROM moved GROUP BY tract HAVING COUNT(*) > 1)"
        " UNION ALL SELECT 'empty', library, tract, 0 FROM moved WHERE tract NOT IN (SELECT tract FROM named)"
        " UNION ALL SELECT 'unserved', NULL, tract, fields FROM named WHERE tract NOT IN (SELECT tract FROM moved)",
        moved=(
            "SELECT DISTINCT library, CASE tract WHEN '381300' THEN '381100' WHEN '381600' THEN '999999' ELSE tract END AS tract"
            " FROM service_area WHERE tract <> '382000'"
        ),
        named="SELECT substr(code, 6, 6) AS tract, COUNT(*) AS fields FROM census GROUP BY ALL",
    ),
    "key_violations": _with(
        "SELECT 'patron_record' AS \"table\", id, COUNT(*) AS times FROM patron_record GROUP BY id HAVING COUNT(*) > 1"
        " UNION ALL SELECT 'record_metadata', id, COUNT(*) FROM record_metadata GROUP BY id HAVING COUNT(*) > 1"
        " UNION ALL SELECT 'hold', id, COUNT(DISTINCT patron_record_id) FROM hold GROUP BY id"
        " HAVING COUNT(DISTINCT patron_record_id) > 1",
        **REPEATED,
    ),
    "service_area_tracts": _with("SELECT DISTINCT library, tract FROM customer_tracts"),
    "service_area_views": _with("SELECT * FROM map_view", **_LAYER),
    "census_code_clean": _with(f"SELECT record_id, field_content, {_CLEAN} AS code FROM varfield"),
    "tract_code": _with(f"SELECT record_id, substr({_CLEAN}, 6, 6) AS tract FROM varfield"),
    "geoid_case": _with(
        f"SELECT id, coalesce(substr({_CLEAN}, 1, 12), 'no data') AS geoid"
        " FROM patron_record LEFT JOIN varfield ON id = record_id"
    ),
    "census_url": _with(
        "SELECT id, CASE WHEN coalesce(field_content, '') = '' THEN 'na'"
        f" ELSE 'https://censusreporter.org/profiles/15000US' || substr({_CLEAN}, 1, 12) END AS url"
        " FROM patron_record LEFT JOIN varfield ON id = record_id"
    ),
    "census_field_match": _with(f"SELECT record_id, field_content, {_MATCH} AS is_match FROM varfield"),
    "tract_filter": _with(f"SELECT id, code FROM census WHERE substr(code, 6, 6) IN ({ASIA_TRACTS})"),
    "tract_join": _with(
        "SELECT tract, id, code, library FROM census JOIN service_area ON tract = substr(code, 6, 6)"
    ),
    "patron_age": _with(f"SELECT id, {_AGE} AS age FROM patron_record"),
    "patron_measures": _with(
        "SELECT id, checkout_total, renewal_total, checkout_total + renewal_total AS circ, checkout_count,"
        f" {_AGE} AS age, {_ACTIVE} AS is_active, {_BLOCKED} AS is_blocked FROM patron_record"
    ),
    "patron_creation": _with(f"SELECT id, {_NEW} AS is_new FROM record_metadata"),
    "mailing_addresses": _with("SELECT * FROM mailing"),
    "patron_holds": _with(
        "SELECT p.id, COUNT(h.patron_record_id) AS holds, COUNT(DISTINCT h.id) AS distinct_holds"
        " FROM patron_record p LEFT JOIN hold h ON h.patron_record_id = p.id GROUP BY p.id"
    ),
    "patron_areas": _with("SELECT substr(code, 1, 12) AS geoid, id, COUNT(*) AS fields FROM census GROUP BY ALL"),
    "patron_stats": _with(_stats(_ASIA, "", "substr(code, 1, 12)", "'15000US'")),
    "patron_stats_distinct_holds": _with(_stats(_ASIA, "", "substr(code, 1, 12)", "'15000US'")),
    "patron_stats_direct": _with(_stats(_ASIA, "", "substr(code, 1, 12)", "'15000US'")),
    "patron_stats_repeated_keys": _with(
        _stats("joined", "", "substr(code, 1, 12)", "'15000US'"), **REPEATED
    ),
    "patron_stats_stored": _with(_stats(_ASIA, "", "substr(code, 1, 12)", "'15000US'")),
    "patron_stats_indexed": _with(_stats(_ASIA, "", "substr(code, 1, 12)", "'15000US'")),
    "patron_stats_indexed_tract": _with(_stats(_ASIA, "", "substr(code, 1, 11)", "'14000US'")),
    "patron_refresh": _level_stats("block_group"),
    "patron_refresh_compacted": _level_stats("block_group"),
    "patron_stats_tract": _level_stats("tract"),
    "patron_stats_county": _level_stats("county"),
    "patron_stats_state": _level_stats("state"),
    "patron_rollup": "SELECT * EXCLUDE (prefix) FROM ("
    + _with(_stats(_LEVELS.format(rows="joined"), "level, prefix,", "substr(code, 1, digits)", "prefix"))
    + ") x",
    "patron_stats_all_libraries": _with(_LIBRARY_STATS),
    "library_rollup": "SELECT * EXCLUDE (prefix) FROM ("
    + _with(
        _stats(
            _LEVELS.format(rows="served"), "library, level, prefix,", "substr(code, 1, digits)", "prefix"
        ),
        served=f"SELECT * FROM {_SERVED}",
    )
    + ") x",
    "stats_min_patrons": _with(
        _stats(
            _SERVED,
            "library,",
            "substr(code, 1, 12)",
            "'15000US'",
            f"HAVING COUNT(DISTINCT id) >= {MIN_PATRONS}",
        )
    ),
    "map_layer": _with("SELECT * FROM layer", **_LAYER),
    "pct_cardholders": _with("SELECT library, geoid, pct_cardholders FROM valued", **_LAYER),
    "unmatched_areas": _with(
        "SELECT * FROM (SELECT library, geoid, total_patrons, geoid IN (SELECT geoid FROM boundary) AS has_boundary,"
        " geoid IN (SELECT geoid FROM population) AS has_population FROM stats) u"
        " WHERE NOT (has_boundary AND has_population)",
        **_LAYER,
    ),
    "label_cardholder": _with(f"SELECT library, geoid, {_CARDHOLDER_LABEL} AS label FROM valued", **_LAYER),
    "label_dual": _with(
        f"SELECT library, geoid, {_LEFT_LABEL} AS cardholder_label, {_RIGHT_LABEL} AS active_label FROM valued",
        **_LAYER,
    ),
    "label_metric": _with(f"SELECT library, geoid, metric, label FROM ({_METRICS}) x", **_LAYER),
    "cardholder_layer": _with(
        "SELECT library, geoid, 'Cardholder Percentage' AS title, pct_cardholders AS value,"
        f" {_CARDHOLDER_LABEL} AS label, lat, lon, zoom FROM layer LEFT JOIN map_view USING (library)",
        **_LAYER,
    ),
    "dual_layer": _with(
        "SELECT library, geoid, CAST(1 AS INT) AS pane, 'Cardholder Percentage' AS title, 'pct_cardholders' AS metric,"
        f" pct_cardholders AS value, {_LEFT_LABEL} AS label, lat, lon, zoom FROM layer LEFT JOIN map_view USING (library)"
        " UNION ALL SELECT library, geoid, 2, 'Active Percentage', 'pct_active',"
        f" CAST(pct_active AS DOUBLE), {_RIGHT_LABEL}, lat, lon, zoom FROM layer LEFT JOIN map_view USING (library)",
        **_LAYER,
    ),
    "metric_long": _with(_METRICS, **_LAYER),
    "geojson_features": _with(
        """SELECT library, geoid, '{"type":"Feature","id":"' || geoid || '","properties":' || CAST(json_object("""
        + ", ".join(f"'{name}', {name}" for name in _PROPERTIES)
        + """) AS VARCHAR) || ',"geometry":' || geometry_json || '}' AS feature FROM layer""",
        **_LAYER,
    ),
}

ORACLE["feature_collection"] = _with(
    "SELECT geoid, total_patrons, pct_cardholders, namelsad, geometry_json FROM layer", **_LAYER
)
ORACLE.update(
    {
        f"published_{output}": f"SELECT *, {_TODAY} AS run_date FROM ({ORACLE[query]}) p"
        for output, query in (
            ("stats", "patron_stats_all_libraries"),
            ("dual", "dual_layer"),
            ("metrics", "metric_long"),
        )
    }
)
ORACLE["published_cardholder"] = ORACLE["cardholder_layer"]
ORACLE["published_features"] = f"SELECT library, feature AS value FROM ({ORACLE['geojson_features']}) p"
