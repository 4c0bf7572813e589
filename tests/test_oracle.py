"""Every query with an SQL twin gives the twin's rows."""

import math

import duckdb
import pytest

from textloom.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if x is None or isinstance(x, str):
        return str(x)
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return "nan" if math.isnan(x) else f"{float(x):.9g}"
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return str(int(x)) if isinstance(x, bool) else str(x)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got
    if name in ORACLE_SQL:
        con = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in con.description]
        assert sorted(names) == sorted(df.columns)
        want = rows(names, con.fetchall())
        assert len(got) == len(want)
        different = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
        assert not different, different[:2]
