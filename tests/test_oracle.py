"""Every query of the registry against its DuckDB twin, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

import tessera.plans.all  # noqa: F401
from tessera import registry
from tests.conftest import SF_SMALL

TABLES = "customer documents embeddings events labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.8g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, con, name):
    df = registry.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    res = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[k]) for k in order) for r in res.fetchall())
