"""The registered queries: names, oracles, plans of the native ones."""

import duckdb
import pytest

import __spark_entry__ as E
from daybars.adapters import TABLES
from daybars.llm import registry
from tools.check_oracle import digest

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(registry.QUERIES) <= set(E.queries()) and set(registry.ORACLES) <= set(registry.QUERIES)
    numbers = sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES if k.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in registry.QUERIES


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cols, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols, want = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(cols) == sorted(ocols) and len(got) == len(want)
    assert digest(cols, got) == digest(ocols, want)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n.split("_")[0] in ("op2", "op3", "op5", "op10")])
def test_native_queries_run_no_python(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
