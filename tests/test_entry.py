"""The registered queries against their DuckDB counterparts on the smallest tables."""

import math

import __spark_entry__ as entry
import duckdb
import pytest
from braidwork.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("nation", "lineitem", "orders", "supplier")
ALL = sorted(catalog.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ALL)
def test_query_matches_its_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    mine = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    theirs = sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())
    assert mine == theirs and mine


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 9 * 2499  # all days on which anything was shipped
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_simulations_and_replicates_are_enough(spark, monkeypatch):
    class Called(Exception):
        pass

    asked = {}

    def listen(module, name, argument):
        from inspect import signature

        plain = getattr(module, name)

        def run(*args, **kwargs):
            bound = signature(plain).bind(None, *args[1:], **kwargs)
            bound.apply_defaults()
            asked[name] = bound.arguments[argument]
            raise Called

        monkeypatch.setattr(module, name, run)

    listen(catalog.R, "simex", "simulations")
    listen(catalog.G, "bootstrap", "replicates")
    for query in ("simex_curve", "gstudy_bootstrap_interval"):
        try:
            catalog.QUERIES[query](spark, SF)
        except Called:
            pass
    assert asked["simex"] >= 200 and asked["bootstrap"] >= 300
