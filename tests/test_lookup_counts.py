import datetime as dt

import pytest

from daybars.operators.aggregates import (
    code_status, collected_range, count_by_market, latest_bar, market_counts_wide, run_summary,
)
from daybars.operators.lookup import lookup_bars
from daybars.schemas import BARS
from tests.conftest import rows

D = dt.date


@pytest.fixture()
def data(spark):
    master = spark.createDataFrame(
        [("005930", "삼성전자", "KOSPI"), ("000001", "Alpha Corp", "KOSDAQ"),
         ("000000", "alpha corp ", "KOSPI"), ("000002", "Beta", "KOSDAQ")],
        "code string, name string, market_type string")
    bars = spark.createDataFrame(
        [(c, D(2025, 1, d), 1.0 * d, 1.0, 1.0, 1.0, d) for c in ["000000", "000001"] for d in (2, 5, 3)],
        BARS)
    return master, bars


def test_lookup_case_insensitive_smallest_code_newest_first(spark, data):
    master, bars = data
    out = lookup_bars(master, bars, "ALPHA CORP")
    got = [(r["code"], r["date"], r["rn"]) for r in out.collect()]   # ordered result
    assert got == [("000000", D(2025, 1, 5), 1), ("000000", D(2025, 1, 3), 2),
                   ("000000", D(2025, 1, 2), 3)]


def test_lookup_case_sensitive(spark, data):
    master, bars = data
    out = lookup_bars(master, bars, "Alpha Corp", case_sensitive=True)
    assert {r["code"] for r in out.collect()} == {"000001"}


def test_lookup_ignores_accents_and_reads_the_bars_once(spark, data, tmp_dir):
    _, bars = data
    master = spark.createDataFrame([("000001", "Café", "KOSPI")], "code string, name string, market_type string")
    bars.write.parquet(f"{tmp_dir}/bars")
    out = lookup_bars(master, spark.read.schema(BARS).parquet(f"{tmp_dir}/bars"), "cafe")
    assert out.count() == 3
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_lookup_not_found_and_validation(spark, data):
    master, bars = data
    with pytest.raises(LookupError):
        lookup_bars(master, bars, "Gamma")
    with pytest.raises(ValueError):
        lookup_bars(master, bars, "  ")


def test_lookup_filter_reaches_scan(spark, data, tmp_dir):
    master, bars = data
    bars.write.parquet(f"{tmp_dir}/bars")
    b = spark.read.schema(BARS).parquet(f"{tmp_dir}/bars")
    plan = lookup_bars(master, b, "Beta")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(code), EqualTo(code,000002)]" in plan


def test_counts(spark, data):
    master, bars = data
    assert rows(count_by_market(master)) == [(None, 4), ("KOSDAQ", 2), ("KOSPI", 2)]
    w = market_counts_wide(master).first()
    assert (w["kospi"], w["kosdaq"], w["total"]) == (2, 2, 4)
    assert rows(collected_range(bars)) == [("000000", D(2025, 1, 2), D(2025, 1, 5), 3),
                                           ("000001", D(2025, 1, 2), D(2025, 1, 5), 3)]
    lb = {r["code"]: (r["date"], r["open"]) for r in latest_bar(bars).collect()}
    assert lb == {"000000": (D(2025, 1, 5), 5.0), "000001": (D(2025, 1, 5), 5.0)}


def test_run_summary_statuses(spark):
    modes = spark.createDataFrame([("a", "incremental"), ("b", "skip"), ("c", "initial"),
                                   ("d", "incremental"), ("e", "initial")], "code string, mode string")
    w = [D(2025, 1, 1), D(2025, 1, 9)]
    plan = spark.createDataFrame([(c, x, x) for c in "acdef" for x in w], "code string, seg_start date, seg_end date")
    win = spark.createDataFrame(
        [("a", w[0], w[1], False, 3), ("c", w[0], w[0], False, 0), ("c", w[1], w[1], False, 0),
         ("d", w[0], w[0], True, 0), ("d", w[1], w[1], False, 2), ("e", w[0], w[0], True, 0)],
        "code string, seg_start date, seg_end date, rejected boolean, n_bars bigint")
    modes = modes.unionByName(spark.createDataFrame([("f", "initial")], modes.schema))     # never answered
    st = {r["code"]: (r["status"], r["n_windows"]) for r in code_status(modes, plan, win).collect()}
    assert st == {"a": ("ok", 2), "b": ("skipped", 0), "c": ("empty", 2), "d": ("partial", 2), "e": ("failed", 2),
                  "f": ("failed", 2)}
    s = run_summary(code_status(modes, plan, win)).first().asDict()
    assert s == {"total": 6, "ok": 1, "empty": 1, "skipped": 1, "partial": 1, "failed": 2}


def test_lookup_rank_across_months(spark):
    import random
    rnd = random.Random(3)
    days = sorted(rnd.sample(range(0, 900), 120))
    dates = [D(2023, 1, 1) + dt.timedelta(days=x) for x in days]
    master = spark.createDataFrame([("9", "Zeta", "KOSPI")], "code string, name string, market_type string")
    bars = spark.createDataFrame([("9", d, 1.0, 1.0, 1.0, 1.0, 1) for d in dates], BARS)
    out = lookup_bars(master, bars, "zeta").collect()
    assert [r["date"] for r in out] == sorted(dates, reverse=True)
    assert [r["rn"] for r in out] == list(range(1, len(dates) + 1))
