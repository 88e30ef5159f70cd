"""Values that results must agree on. They are plain data, not tuning knobs."""

# Codes stored in the patron tables.
CENSUS_FIELD_TYPE = "k"
MAILING_ADDRESS_TYPE = "1"
NOT_BLOCKED_CODE = "-"
BLOCKING_DEBT = 10

# Patterns of the tagged census field, e.g. |s25|c017|t383101|b1. The pipe stands
# in a character class, which needs no escape in Python, in Spark or in SQL text.
CENSUS_FIELD_START = "|s"
CENSUS_FIELD_PATTERN = r"^[|]s\d{2}"
SUBFIELD_MARKER_PATTERN = r"[|][sctb]"

# Text used where a record has no census field.
NO_FIELD_AREA = "no data"
NO_FIELD_URL = "na"

# Digits of the cleaned code that name an area, and the summary
# level code which the profile address of such an area starts with.
PROFILE_ADDRESS = "https://censusreporter.org/profiles/"
LEVELS = {
    "state": (2, "04000US"),
    "county": (5, "05000US"),
    "tract": (11, "14000US"),
    "block_group": (12, "15000US"),
}
TRACT_START = 6
TRACT_LENGTH = 6

# Output columns of the area statistics, in order.
STAT_COLUMNS = [
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
]

# Metrics of the long layer in menu order; the first is shown first.
METRICS = [
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
]

# Titles of the cardholder and active layers.
CARDHOLDER_TITLE = "Cardholder Percentage"
ACTIVE_TITLE = "Active Percentage"

# Hover labels; names in braces are columns.
CARDHOLDER_LABEL = (
    "<b>{geographic_area_name}</b><br>"
    "Cardholder %: {pct_cardholders}%</b><br>"
    "Patron Total: {total_patrons}</b><br>"
    "Est. Pop: {estimated_population}</b><br>"
    "Total checkouts: {total_checkouts}</b><br>"
    "Active Patron %: {pct_active}%</b><br>"
    "Blocked Patron %: {pct_blocked}%<extra></extra>"
)
DUAL_CARDHOLDER_LABEL = (
    "<b>{geographic_area_name}</b><br>"
    "{pct_cardholders}%</b><br>"
    "Patron Total: {total_patrons}</b><br>"
    "Est. Pop: {estimated_population}<extra></extra>"
)
DUAL_ACTIVE_LABEL = (
    "<b>{geographic_area_name}</b><br>"
    "{pct_active}%</b><br>"
    "Patron Total: {total_patrons}</b><br>"
    "Active Patron Total: {total_active_patrons}</b><br><extra></extra>"
)
METRIC_LABEL = "<b>{geographic_area_name}</b><br>Total: {value_text}<extra></extra>"
