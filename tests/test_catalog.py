import datetime
import decimal

import duckdb
import pytest

from loomtext import catalog

AT = "/root/testdata/sf0.01"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    " clicks sales sale_lines clients client_changes vendors items stamps"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{AT}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 5)
    return x.isoformat() if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_against_sql(spark, duck, name):
    got = catalog.queries()[name](spark, AT)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    res = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in res.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in res.fetchall()), key=str)
    assert sorted(names) == columns
    assert len(rows) == len(want)
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    assert not bad, bad[:3]
    assert rows
