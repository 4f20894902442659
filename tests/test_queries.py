"""Every core query with SQL equals it on the smallest tables; the entry runs."""

import pytest
from compare import both, connect

import __spark_entry__
from tonearm.plans import library, listening, syncing, upkeep

SF = "/root/testdata/sf0.001"
CORE = {n: (q, r.sql[n]) for r in (upkeep.REGISTRY, listening.REGISTRY, syncing.REGISTRY, library.REGISTRY) for n, q in r.queries.items() if n in r.sql}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_sql(spark, con, name):
    query, sql = CORE[name]
    got, want = both(spark, con, name, query, sql, SF)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
