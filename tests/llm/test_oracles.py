"""The corpus queries give the rows of their SQL."""

import os

import duckdb
import pytest

from regionframe.llm import queries

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got = con.execute(queries.ORACLES[name])
    names = [x[0] for x in got.description]
    want = got.fetchall()
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted(rows, key=repr)
    found, right = key(tuple(r[c] for c in names) for r in df.collect()), key(want)
    assert len(found) == len(right)
    assert [(x, y) for x, y in zip(found, right) if x != y][:3] == []
