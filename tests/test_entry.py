"""The driver's contract."""

import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["keyword_top", "review_coverage", "source_statistics", "url_checks"])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    base = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{base}/{t}.parquet')")
    df = entry.queries()[name](spark, base)
    got = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.fetchall())) == sorted(map(key, df.select(*names).collect()))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_the_subpackage_may_be_absent(monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("evidentia.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    fresh = importlib.reload(entry)
    assert "keyword_top" in fresh.queries() and "pipeline" not in fresh.queries()
    monkeypatch.undo()
    importlib.reload(entry)
