"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from lineagekit.plans import catalogue
from lineagekit.session import TABLES

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, bool):
        return str(int(value))
    return repr(float(value)) if isinstance(value, float) else str(value)


def rows(columns, found):
    return sorted([tuple((v is None, "" if v is None else plain(v)) for v in r) for r in found]), columns


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(name, spark, duck):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = rows(columns, [tuple(r) for r in df.select(*columns).collect()])
    if name not in catalogue.ORACLE_SQL:
        assert got[0]
        return
    relation = duck.sql(catalogue.ORACLE_SQL[name])
    names = sorted(relation.columns)
    assert got == rows(names, relation.select(*[f'"{c}"' for c in names]).fetchall())
