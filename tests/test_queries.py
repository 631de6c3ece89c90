"""Every registered query of the alignment library against its oracle."""

import collections
import glob
import os

import duckdb
import pytest

from helixframe.plans import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_oracle(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'").fetchall()
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, data).toArrow()
    cols = sorted(got.column_names)
    assert cols == sorted(want.columns)
    found = want.to_arrow_table()
    rows = lambda t: collections.Counter(zip(*[t.column(c).to_pylist() for c in cols]))
    assert rows(got) == rows(found)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
