"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from fluxmere.plans import catalogue  # noqa: E402


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(str([_norm(r[c]) for c in cols]) for r in df.collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    r = con.sql(catalogue.ORACLES[name])
    at = [list(r.columns).index(c) for c in cols]
    assert sorted(r.columns) == cols
    assert got == sorted(str([_norm(x[i]) for i in at]) for x in r.fetchall())


def test_entry_without_the_corpus_subpackage(monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert not [n for n in e.queries() if n.startswith("op")]
    assert "word_count" in e.queries() and "word_count" in e.oracle_sql()
