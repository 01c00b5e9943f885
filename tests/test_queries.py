"""Every query of the core against its SQL, or that it runs."""

from __future__ import annotations

import pytest

from palaver.plans import registries
from tests.oracle import DATA, compare

QUERIES = {n: f for r in registries() for n, f in r.queries.items()}
SQL = {n: s for r in registries() for n, s in r.sql.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
