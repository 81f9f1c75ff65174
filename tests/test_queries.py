"""Every registered query against its SQL equivalent on the smallest tables."""

import duckdb
import pytest

from sofralytics.plans import load_queries
from sofralytics.plans.adapters import TABLE_NAMES
from tests.conftest import SMALL
from tools.compare import rows_of

REGISTRY = load_queries()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLE_NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(REGISTRY.BUILDERS))
def test_query(spark, con, name):
    frame = REGISTRY.BUILDERS[name](spark, SMALL)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if name in REGISTRY.ORACLES:
        cur = con.execute(REGISTRY.ORACLES[name])
        assert got == rows_of([d[0] for d in cur.description], cur.fetchall())
    else:
        assert len(set(frame.columns)) == len(frame.columns)


def test_every_oracle_has_a_query():
    assert set(REGISTRY.ORACLES) <= set(REGISTRY.BUILDERS)
