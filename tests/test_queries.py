"""Every registered claims query against its SQL on the smallest tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from ledgerline.plans.claims_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, (float, Decimal)):
        return "null" if x != x else f"{float(x):.6g}"
    return "null" if x is None else str(list(x)) if isinstance(x, (list, tuple)) else str(x)


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(got, df.columns) == rows(want.fetchall(), names)
