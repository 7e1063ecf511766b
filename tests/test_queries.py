"""Every registered query against its SQL over the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(frame, columns):
    """Rows as texts. Whole numbers are integers, as a column of them that holds a null comes as floats from one side."""
    rows = frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)
    return sorted(repr(tuple(int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n != "pipeline"])
def test_query(spark, oracle, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), oracle.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got, sorted(got.columns)) == plain(want, sorted(got.columns))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
