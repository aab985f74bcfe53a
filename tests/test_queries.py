"""Every registered query against its SQL, and what the plans may contain."""

import re

import duckdb
import pytest

from barloom.plans.catalog import ORACLES, QUERIES
from tools.check import TABLES, rows


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    text = df._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas", "SortAggregate"):
        assert word not in text, word
    # row windows never run on a whole symbol: only summaries and per-task limited top lists may
    for line in text.splitlines():
        found = re.search(r"Window \[row_number.*\], \[symbol#\d+\], \[", line)
        assert not found or "WindowGroupLimit" in text, line[:200]
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def over_blocks():
    """Queries whose rows are cut into blocks."""
    modules = {"barloom.plans.q_technical", "barloom.plans.q_flow"}
    some = {"all_families", "portfolio_metrics", "year_windows", "decayed_sentiment", "windows_with_nulls", "forward_targets", "sequence_windows"}
    return sorted(n for n in ORACLES if n in some or QUERIES[n].plain.__module__ in modules)


@pytest.mark.parametrize("name", over_blocks())
def test_small_blocks(spark, sf, con, name, monkeypatch):
    """The same results when every series crosses many block borders."""
    import barloom.functions.series as series

    monkeypatch.setattr(series, "SIZE", 48)
    monkeypatch.setattr(series, "GROUP", 4)
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert "rank" in df.columns and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
