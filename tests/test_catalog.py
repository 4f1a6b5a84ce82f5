"""Every named query against its DuckDB counterpart, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quillon.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else f"{v:.6g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(n for n in catalog.queries() if not n.startswith("cursor_")))
def test_query(spark, tables, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = tables.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()) == want


def test_each_query_has_its_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()
