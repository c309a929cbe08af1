"""Every query that has SQL gives the same rows in DuckDB; every query of the core runs."""

import pytest

from graftwork.plans import core_queries, features, files, ledger, list_group, records, reports, review

MODULES = (core_queries, list_group, features, review, reports, records, ledger, files)
ALL = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, spark, sf_dir, same):
    same(ALL[name](spark, sf_dir), SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(ALL.keys() - SQL.keys()))
def test_query_runs(name, spark, sf_dir):
    assert ALL[name](spark, sf_dir).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= ALL.keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).count() > 0
