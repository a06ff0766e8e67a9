"""Every query of the reference's operators against its DuckDB statement, on the smallest tables."""

import os

import duckdb
import pytest

from covista.plans import queries  # noqa: F401  (registers)
from covista.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def plain(rows):
    out = [tuple(None if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    if name not in ORACLES:
        assert got
        return
    r = db.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert got == plain([[row[names.index(c)] for c in columns] for row in r.fetchall()])
