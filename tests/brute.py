"""Plain Python statistics over joined rows, for small tables."""

from __future__ import annotations

from datetime import date
from decimal import ROUND_HALF_UP, Decimal
import re

LENGTHS = {"state": 2, "county": 5, "tract": 11, "block_group": 12}
PREFIXES = {"state": "04000US", "county": "05000US", "tract": "14000US", "block_group": "15000US"}


def _years(birth: date, today: date) -> int:
    months = (today.year - birth.year) * 12 + today.month - birth.month
    if today.day < birth.day:
        months -= 1
    return int(months / 12)


def _text(part: int, whole: int) -> str:
    return str((Decimal(part) / Decimal(whole)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def _total(values):
    known = [value for value in values if value is not None]
    return sum(known) if known else None


def _either(left, right):
    if left or right:
        return True
    return None if left is None or right is None else False


def stats(data: dict[str, list[tuple]], today: date, tracts=None, level="block_group") -> list[tuple]:
    """Rows of (geoid, ..., url), keyed like the Spark output."""
    cutoff = date(today.year - 1, today.month, min(today.day, 28))
    groups: dict[str, list[tuple]] = {}
    for patron in data["patron_record"]:
        pid = patron[0]
        for _ in [a for a in data["patron_record_address"] if a == (pid, "1")]:
            for created in [m[1] for m in data["record_metadata"] if m[0] == pid]:
                holds = [h[0] for h in data["hold"] if h[1] == pid] or [None]
                for hold in holds:
                    for record, kind, text in data["varfield"]:
                        if record != pid or kind != "k" or not re.match(r"\|s\d\d", text or ""):
                            continue
                        code = re.sub(r"\|[sctb]", "", text)
                        if tracts is not None and code[5:11] not in tracts:
                            continue
                        groups.setdefault(code[: LENGTHS[level]], []).append((patron, created, hold))
    result = []
    for geoid, rows in groups.items():
        ids = {p[0] for p, _, _ in rows}
        new = {p[0] for p, c, _ in rows if c is not None and c.date() >= cutoff}
        active = {p[0] for p, _, _ in rows if p[5] is not None and p[5].date() >= cutoff}
        blocked = {
            p[0]
            for p, _, _ in rows
            if _either(None if p[6] is None else p[6] != "-", None if p[7] is None else p[7] >= 10)
        }
        ages = [_years(p[4], today) for p, _, _ in rows if p[4] is not None]
        checkouts = _total(p[1] for p, _, _ in rows)
        result.append(
            (
                geoid,
                len(ids),
                checkouts,
                _total(p[2] for p, _, _ in rows),
                _total(None if None in p[1:3] else p[1] + p[2] for p, _, _ in rows),
                _total(p[3] for p, _, _ in rows),
                len({h for _, _, h in rows if h is not None}),
                float(round(sum(ages) / len(ages))) if ages else None,
                len(new),
                len(active),
                _text(100 * len(active), len(ids)),
                len(blocked),
                _text(100 * len(blocked), len(ids)),
                None if checkouts is None else _text(checkouts, len(ids)),
                "https://censusreporter.org/profiles/" + PREFIXES[level] + geoid,
            )
        )
    return sorted(result, key=lambda row: (-row[1], row[0]))
