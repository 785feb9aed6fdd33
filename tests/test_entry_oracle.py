"""The driver contract: entry() runs, and every registered query equals its
DuckDB oracle on the smallest driver tables."""

import duckdb
import pytest

import __spark_entry__ as E
from daybars.adapters import TABLES
from daybars.plans import registry, registry_incremental
from tests.conftest import SF_SMALL
from tools.check_oracle import digest

NAMES = sorted(registry.QUERIES | registry_incremental.QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["code", "date", "open_change_rate", "close_change_rate",
                          "high_change_rate", "low_change_rate", "volume_change_rate"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(registry.oracle() | registry_incremental.oracle()) == set(NAMES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols, want = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(got) == len(want)
    assert digest(cols, got) == digest(ocols, want)
    # everything stays JVM-side: no Python evaluation node in the plan
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "PythonUDF",
                 "FlatMapGroupsInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, node
