import datetime as dt

from daybars.operators.integrity import duplicate_keys, fk_orphans, fk_valid, quality_report
from daybars.schemas import BARS, FEATURES
from tests.conftest import rows

D = dt.date


def test_quality_report_counts(spark):
    master = spark.createDataFrame(
        [("1", "a", "KOSPI"), ("1", "b", "KOSPI"), ("2", None, "NYSE"), ("12345678901", "c", "KOSDAQ")],
        "code string, name string, market_type string")
    bars = spark.createDataFrame(
        [("1", D(2025, 1, 1), 1.0, 1.0, 1.0, 1.0, 1), ("1", D(2025, 1, 1), 1.0, 1.0, 1.0, 1.0, 1),
         ("9", D(2025, 1, 1), 1.0, 1.0, 1.0, 1.0, 1)], BARS)
    feats = spark.createDataFrame([("1", D(2025, 1, 2), None, 1.0, 1.0, 1.0, None)], FEATURES)
    rep = {(r["tbl"], r["check_name"]): r["n_bad"] for r in quality_report(master, bars, feats).collect()}
    assert rep[("master", "dup_code")] == 1
    assert rep[("master", "null_name")] == 1
    assert rep[("master", "len_code")] == 1
    assert rep[("master", "domain_market_type")] == 1
    assert rep[("bars", "dup_code_date")] == 1
    assert rep[("bars", "orphan_code")] == 1
    assert rep[("features", "null_open_change_rate")] == 1
    assert rep[("features", "orphan_code")] == 0
    assert sum(rep.values()) == 7   # volume_change_rate may be NULL


def test_fk_and_duplicates(spark):
    master = spark.createDataFrame([("1",), ("2",)], "code string")
    bars = spark.createDataFrame([("1", D(2025, 1, 1), 1.0, 1.0, 1.0, 1.0, 1),
                                  ("3", D(2025, 1, 1), 1.0, 1.0, 1.0, 1.0, 1)], BARS)
    assert rows(fk_valid(bars, master), "code") == [("1",)]
    assert rows(fk_orphans(bars, master), "code") == [("3",)]
    assert duplicate_keys(bars, ["code", "date"]).count() == 0
