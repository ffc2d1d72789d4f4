"""Each query against its SQL on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb
import pytest

from siftline.plans.oracles import ORACLES
from siftline.plans.queries import QUERIES
from tests.conftest import TESTDATA

TABLES = "events orders lineitem documents"


def plain(x):
    if isinstance(x, datetime.datetime):
        return x.date()
    if isinstance(x, (float, decimal.Decimal)):
        return None if math.isnan(x) else round(float(x), 5)
    return x


@pytest.mark.parametrize("name", QUERIES)
@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query(spark, name, sf):
    got = QUERIES[name](spark, f"{TESTDATA}/{sf}")
    columns = sorted(got.columns)
    rows = Counter(tuple(map(plain, r)) for r in got.select(*columns).collect())
    if name not in ORACLES:
        assert rows
        return
    with duckdb.connect() as db:
        for t in TABLES.split():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/{sf}/{t}.parquet'")
        frame = db.execute(ORACLES[name])
        names = [c[0] for c in frame.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        want = Counter(tuple(plain(r[k]) for k in order) for r in frame.fetchall())
    assert rows == want and rows


@pytest.mark.parametrize("name,table", [("context_window", "events"), ("fuzzy_anchor", "events"), ("line_payloads", "events"), ("range_anomalies", "events"), ("restored_texts", "documents")])
def test_read_once(spark, small, name, table):
    """What a query uses several times is kept, so that its last plan doesn't parse or scrub the table again."""
    assert not any(f"/{table}.parquet" in f for f in QUERIES[name](spark, small).inputFiles())
