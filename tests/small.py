"""Small patron tables made in memory."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

from tractwise import PatronTables
from tractwise.sources.schemas import TABLES

TODAY = date(2024, 2, 29)


def patron(pid, checkouts=10, renewals=1, current=2, birth=date(1990, 1, 1),
           active=datetime(2024, 1, 1), code="-", owed=Decimal("0.00")):
    return (pid, checkouts, renewals, current, birth, active, code, owed)


def data(patrons, addresses=None, metadata=None, holds=(), fields=None):
    """Tables around ``patrons``: by default one address, one recent record and one
    field in the same block group for each."""
    ids = [p[0] for p in patrons]
    return {
        "patron_record": list(patrons),
        "patron_record_address": [(i, "1") for i in ids] if addresses is None else list(addresses),
        "record_metadata": [(i, datetime(2024, 1, 1)) for i in ids] if metadata is None else list(metadata),
        "hold": list(holds),
        "varfield": [(i, "k", "|s25|c017|t383101|b1") for i in ids] if fields is None else list(fields),
    }


def tables(spark, rows, **options) -> PatronTables:
    return PatronTables(
        **{name: spark.createDataFrame(rows[name], schema) for name, (schema, _) in TABLES.items()},
        **options,
    )


def random_data(seed: int, hot: bool = False) -> dict[str, list[tuple]]:
    """Tables with repeats, gaps and NULLs; ``hot`` gives one patron most rows."""
    rng = random.Random(seed)
    ids = list(range(1, 41))

    def moment():
        return rng.choice([None, datetime(2023, 2, 28), datetime(2023, 2, 27, 23, 59), datetime(2024, 1, 5)])

    def field():
        if rng.random() < 0.15:
            return rng.choice([None, "", "unmatched address", "|sx5|c017|t383101|b1"])
        county, tract, group = rng.choice(["017", "021"]), rng.choice(["383101", "383102", "980000"]), rng.randint(1, 3)
        return f"|s25|c{county}|t{tract}|b{group}"

    patrons = [
        (
            i,
            rng.choice([None, 0, 3, 250]),
            rng.choice([None, 1, 7]),
            rng.randint(0, 5),
            rng.choice([None, date(2000, 2, 29), date(1990, 3, 1), TODAY - timedelta(days=rng.randint(0, 30000))]),
            moment(),
            rng.choice([None, "-", "b"]),
            rng.choice([None, Decimal("9.99"), Decimal("10.00")]),
        )
        for i in ids
    ]
    holds = [(n, rng.choice([None, *ids])) for n in range(100)]
    holds += rng.sample([h for h in holds if h[1]], 10)
    fields = [(rng.choice(ids), rng.choice("kkkx"), field()) for _ in range(80)]
    addresses = [(rng.choice(ids), rng.choice("112")) for _ in range(70)]
    if hot:
        holds += [(1000 + n, 1) for n in range(60)]
        addresses += [(1, "1")] * 5
        fields += [(1, "k", "|s25|c017|t383101|b1")] * 7
    return {
        "patron_record": patrons,
        "patron_record_address": addresses,
        "record_metadata": [(i, moment()) for i in ids if i % 7],
        "hold": holds,
        "varfield": fields,
    }
