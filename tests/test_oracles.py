"""Every query with SQL gives the SQL's rows; the others run and keep their columns."""

import duckdb
import pytest

import __spark_entry__ as entry
from textlake.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple("" if x is None else f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*names).collect()]
    if name in entry.oracle_sql():
        want = duck.execute(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert plain(rows) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]
