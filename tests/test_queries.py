"""Registered queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from quayside import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else (float(v) + 0.0 if isinstance(v, float) else v)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    told = duck.execute(registry.ORACLES[name])
    want = rows([d[0] for d in told.description], told.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in told.description)
    assert got == want


def test_every_query_runs(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLES)):
        registry.QUERIES[name](spark, SF).limit(5).collect()


@pytest.mark.parametrize(
    "odd,pcts",
    [
        ("CASE WHEN event_id % 3 < 2 THEN 0.0 WHEN event_id % 2 = 0 THEN value ELSE -value END AS value", {"inf", "-inf", "nan", "None"}),
        ("""CASE WHEN event_id % 3 < 2 THEN '{"k": -1}' ELSE props END AS props""", {"None"}),
    ],
)
def test_price_anchors_from_references_of_zero(spark, tmp_path, odd, pcts):
    """Prices of 0, and bars without units: NaN, infinite and null differ."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE ({odd}) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    told = c.execute(registry.ORACLES["price_anchors"])
    names, want = [d[0] for d in told.description], told.fetchall()
    got = [tuple(r) for r in registry.QUERIES["price_anchors"](spark, str(tmp_path)).select(*names).collect()]
    assert pcts <= {repr(r[names.index("pct")]) for r in want}
    assert sorted(map(repr, got)) == sorted(map(repr, want))
