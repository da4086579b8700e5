"""Corpus queries against their SQL, on the smallest tables."""


import duckdb
import pytest

from fluxmere.llm import queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    r = con.sql(queries.oracle_sql()[name])
    at = [list(r.columns).index(c) for c in cols]
    assert sorted(r.columns) == cols
    assert sorted(str([x[c] for c in cols]) for x in df.collect()) == sorted(str([x[i] for i in at]) for x in r.fetchall())


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.queries() if n.startswith("op")] == [f"op{i}" for i in range(1, 11)]
