"""Every catalogue query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from talentspark.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "None" if pd.isna(v) else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in frame.astype(object).values.tolist())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
