import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from daybars.adapters import bars_from_events, load, quote_json_lines, quote_records
from daybars.operators.features import features_full
from daybars.schemas import BARS, FEATURES
from daybars.sources import tables
from daybars.sources.tables import read_months, read_table, write_table
from daybars.streaming.catchup import start_catchup
from tests.conftest import SF_SMALL, rows

D = dt.date


def one_bar(spark, code="A", day=D(2025, 1, 1), close=1.0):
    return spark.createDataFrame([(code, day, 1.0, 1.0, 1.0, close, 1)], BARS)


def test_whole_table_is_replaced_by_a_plan_that_reads_it(spark, tmp_dir):
    root = f"{tmp_dir}/bars"
    assert read_table(spark, root, BARS).count() == 0
    write_table(one_bar(spark), root)
    write_table(read_table(spark, root, BARS).withColumn("close", F.col("close") + 1), root, sort_by=["code"])
    assert [r["close"] for r in read_table(spark, root, BARS).collect()] == [2.0]
    assert read_table(spark, root, BARS).columns == BARS.fieldNames()


def test_a_failed_write_changes_nothing(spark, tmp_dir):
    root = f"{tmp_dir}/bars"
    both = one_bar(spark).unionByName(one_bar(spark, day=D(2025, 2, 1)))
    tables.write_months(both, root, ["2025-01", "2025-02"])
    poison = both.withColumn("close", F.when(F.col("date") > "2025-01-15", F.raise_error(F.lit("boom")).cast("double")).otherwise(7.0))
    with pytest.raises(Exception, match="boom"):
        tables.write_months(poison, root, ["2025-01", "2025-02"])
    assert rows(read_months(spark, root, BARS)) == rows(both)


def test_writers_on_other_months_both_stay(spark, tmp_dir):
    root = f"{tmp_dir}/bars"
    for m in (1, 2, 3):
        tables.merge_months(spark, root, one_bar(spark, day=D(2025, m, 1)), ["code", "date"], BARS)
    assert tables.stored_months(spark, root) == ["2025-01", "2025-02", "2025-03"]
    assert read_months(spark, root, BARS).count() == 3


def test_month_files_hold_disjoint_ranges_of_codes(spark, tmp_dir):
    root = f"{tmp_dir}/bars"
    bars = bars_from_events(load(spark, SF_SMALL, "events"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.merge_months(spark, root, bars, ["code", "date"], BARS, sort_by=["code", "date"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = (read_months(spark, root, BARS).groupBy(F.input_file_name().alias("f"))
             .agg(F.min("code").alias("a"), F.max("code").alias("b")).orderBy("a").collect())
    assert len(files) > 2
    assert all(x["b"] < y["a"] for x, y in zip(files, files[1:]))


def test_stream_catchup_late_corrections_and_features(spark, tmp_dir):
    ev = load(spark, SF_SMALL, "events")
    bars = bars_from_events(ev)
    prelim = bars_from_events(ev.where(F.col("event_type") != "purchase"))
    land = f"{tmp_dir}/landing"
    # two deliveries; the stream runs once per delivery (late data arrives
    # after the first catch-up)
    quote_json_lines(quote_records(prelim, "2024-01-30", 1)).write.text(f"{land}/d1")
    q = start_catchup(spark, f"{land}/*", f"{tmp_dir}/bars", f"{tmp_dir}/ck",
                      features_root=f"{tmp_dir}/features")
    q.awaitTermination()
    assert q.exception() is None
    assert rows(read_months(spark, f"{tmp_dir}/bars", BARS)) == rows(prelim)
    quote_json_lines(quote_records(bars, "2024-01-30", 2)).write.text(f"{land}/d2")
    q = start_catchup(spark, f"{land}/*", f"{tmp_dir}/bars", f"{tmp_dir}/ck",
                      features_root=f"{tmp_dir}/features")
    q.awaitTermination()
    assert q.exception() is None
    final = read_months(spark, f"{tmp_dir}/bars", BARS)
    assert rows(final) == rows(bars)
    feats = read_months(spark, f"{tmp_dir}/features", FEATURES)
    assert rows(feats) == rows(features_full(bars))


def test_month_tables_rewrite_only_touched_months(spark, tmp_dir):
    from daybars.operators.keyed import upsert
    from daybars.sources.tables import merge_months, write_months

    def files():
        found = read_months(spark, root, BARS).select(F.input_file_name().alias("f")).distinct().collect()
        return {m: {r["f"] for r in found if f"month={m}/" in r["f"]} for m in tables.stored_months(spark, root)}

    root = f"{tmp_dir}/bars_m"
    bars = bars_from_events(load(spark, SF_SMALL, "events"))
    # initial load: January 2024, plus one December bar
    dec = spark.createDataFrame([("1", D(2023, 12, 29), 1.0, 1.0, 1.0, 1.0, 1)], BARS)
    write_months(bars.unionByName(dec), root, ["2023-12", "2024-01"], sort_by=["code", "date"])
    assert rows(read_months(spark, root, BARS)) == rows(bars.unionByName(dec))
    before = files()
    # a change set in February and one January correction
    ch = spark.createDataFrame([("1", D(2024, 2, 1), 2.0, 2.0, 2.0, 2.0, 2),
                                ("1", D(2024, 1, 2), 9.0, 9.0, 9.0, 9.0, 9)], BARS)
    merge_months(spark, root, ch, ["code", "date"], BARS, sort_by=["code", "date"])
    after = files()
    assert after["2023-12"] == before["2023-12"] and not after["2024-01"] & before["2024-01"]
    want = upsert(bars.unionByName(dec), ch, ["code", "date"])
    assert rows(read_months(spark, root, BARS)) == rows(want)
    assert rows(read_months(spark, root, BARS, months=["2024-02"])) == rows(ch.where("date >= '2024-02-01'"))
    # a month rewritten empty disappears
    write_months(spark.createDataFrame([], BARS), root, ["2023-12"])
    assert tables.stored_months(spark, root) == ["2024-01", "2024-02"]
    assert rows(read_months(spark, root, BARS)) == rows(want.where("date >= '2024-01-01'"))


def test_month_summary_fills_in_missing_months(spark, tmp_dir):
    from daybars.operators.features import month_summary
    from daybars.sources.tables import changed_months, read_summary, write_months, write_summary

    broot, sroot = f"{tmp_dir}/b", f"{tmp_dir}/s"
    bars = bars_from_events(load(spark, SF_SMALL, "events"))
    write_months(bars, broot, changed_months(bars))
    assert rows(read_summary(spark, broot, sroot, BARS)) == rows(month_summary(bars))     # none stored yet
    write_summary(spark, broot, sroot, changed_months(bars), BARS)
    more = spark.createDataFrame([("1", D(2024, 2, 3), 5.0, 5.0, 5.0, 5.0, 5)], BARS)
    tables.merge_months(spark, broot, more, ["code", "date"], BARS)                       # its summary was never written
    assert rows(read_summary(spark, broot, sroot, BARS)) == rows(month_summary(read_months(spark, broot, BARS)))


def test_latest_bars_follow_changes(spark, tmp_dir):
    from daybars.operators.aggregates import latest_bar
    from daybars.sources.tables import merge_latest, rebuild_latest

    root = f"{tmp_dir}/latest"
    merge_latest(spark, root, one_bar(spark).unionByName(one_bar(spark, "B")), BARS)
    merge_latest(spark, root, one_bar(spark, close=5.0).unionByName(one_bar(spark, "B", D(2024, 1, 1), 9.0)), BARS)
    assert rows(read_table(spark, root, BARS), "code", "close") == [("A", 5.0), ("B", 1.0)]     # same day replaces, older does not
    bars = bars_from_events(load(spark, SF_SMALL, "events"))
    tables.merge_months(spark, f"{tmp_dir}/b", bars, ["code", "date"], BARS)
    rebuild_latest(spark, f"{tmp_dir}/b", root, BARS)
    assert rows(read_table(spark, root, BARS)) == rows(latest_bar(bars).select(*BARS.fieldNames()))


def test_checks_are_counted_by_the_write(spark, tmp_dir):
    from daybars.plans.jobs import job_checks
    from daybars.schemas import LENGTH_LIMITS

    root, checks = f"{tmp_dir}/c", tables.checks_of(BARS, LENGTH_LIMITS, ("volume", (1, 2)))
    good = one_bar(spark).unionByName(one_bar(spark, "B"))
    ran = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def tick(code):
        ran.add(1)
        return code
    out = tables.materialised(good.withColumn("code", tick("code")), "bars", checks, root, "r1")
    assert rows(out) == rows(good) and ran.value == 2                # one pass wrote and counted
    bad = one_bar(spark, "x" * 11).select("code", F.lit(None).cast("date").alias("date"), "open", "high", "low", "close",
                                          F.lit(3).cast("bigint").alias("volume"))
    with pytest.raises(tables.BrokenConstraint, match="null_date: 1, len_code: 1, domain_volume: 1"):
        tables.materialised(bad, "bars", checks, root, "r2")
    got = {r["check_name"]: (r["n_rows"], r["n_bad"]) for r in job_checks(spark, root).collect()}
    assert got["null_date"] == got["len_code"] == got["domain_volume"] == (3, 1) and got["null_open"] == (3, 0)


def test_stream_catchup_with_processing_time_trigger(spark, tmp_dir):
    bars = bars_from_events(load(spark, SF_SMALL, "events"))
    quote_json_lines(quote_records(bars, "2024-01-30", 1)).write.text(f"{tmp_dir}/land/d1")
    q = start_catchup(spark, f"{tmp_dir}/land/*", f"{tmp_dir}/bars", f"{tmp_dir}/ck",
                      summary_root=f"{tmp_dir}/sum", every="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert q.exception() is None
    assert rows(read_months(spark, f"{tmp_dir}/bars", BARS)) == rows(bars)


def test_streamed_reject_is_planned_again(spark, tmp_dir):
    import json

    from daybars.plans.jobs import job_plan
    from daybars.schemas import MASTER

    write_table(spark.createDataFrame([(c, c, "KOSPI", None, None) for c in "ABC"], MASTER), f"{tmp_dir}/m")
    for c in "ABC":
        tables.merge_months(spark, f"{tmp_dir}/b", one_bar(spark, c, D(2025, 3, 1)), ["code", "date"], BARS)
    roots = dict(coverage_root=f"{tmp_dir}/cov")
    plan = job_plan(spark, f"{tmp_dir}/m", f"{tmp_dir}/b", "2025-03-03", record=True, **roots)
    assert {(r["code"], r["seg_start"], r["seg_end"]) for r in plan.collect()} == {(c, D(2025, 3, 2), D(2025, 3, 3)) for c in "ABC"}

    def land(day, rt):          # A is answered or rejected; C is never answered
        os.makedirs(f"{tmp_dir}/land", exist_ok=True)
        with open(f"{tmp_dir}/land/{day}.json", "w") as f:
            for code, ok in rt:
                f.write(json.dumps({"code": code, "window_start": "20250302" if day == 3 else f"202503{day:02d}",
                                    "window_end": f"202503{day:02d}", "rt_cd": "0" if ok else "1", "msg1": "",
                                    "output2": [{"stck_bsop_date": f"202503{day:02d}"}] if ok else None}) + "\n")
        q = start_catchup(spark, f"{tmp_dir}/land", f"{tmp_dir}/b", f"{tmp_dir}/ck", latest_root=f"{tmp_dir}/latest", **roots)
        q.awaitTermination()
        assert q.exception() is None
    land(3, [("A", False), ("B", True)])
    land(4, [("A", True), ("B", True), ("C", True)])                # newer bars move past the failures
    again = job_plan(spark, f"{tmp_dir}/m", f"{tmp_dir}/b", "2025-03-04", **roots)
    assert rows(again, "code", "mode", "seg_start", "seg_end") == [
        (c, "gap", D(2025, 3, 2), D(2025, 3, 3)) for c in "AC"]


def test_stream_quarantines_unknown_codes_and_repeats_cleanly(spark, tmp_dir):
    from daybars.schemas import MASTER
    from daybars.sources.quotes import read_quotes
    from daybars.streaming.catchup import make_batch_writer

    write_table(spark.createDataFrame([("1", "n", "KOSPI", None, None)], MASTER), f"{tmp_dir}/m")
    bars = bars_from_events(load(spark, SF_SMALL, "events"))
    quote_json_lines(quote_records(bars, "2024-01-30", 1)).write.text(f"{tmp_dir}/land")
    run = make_batch_writer(f"{tmp_dir}/bars", f"{tmp_dir}/f", f"{tmp_dir}/q", f"{tmp_dir}/s", f"{tmp_dir}/m", "s1")
    for _ in range(2):                            # the same batch again, as after a failure
        run(read_quotes(spark, f"{tmp_dir}/land"), 0)
    stored = read_months(spark, f"{tmp_dir}/bars", BARS)
    assert rows(stored) == rows(bars.where("code = '1'"))
    bad = spark.read.parquet(f"{tmp_dir}/q")
    assert bad.count() + stored.count() == bars.count() and {r["reason"] for r in bad.collect()} == {"unknown code"}


def test_large_change_sets_are_not_broadcast(spark, tmp_dir, monkeypatch):
    """By rows, not by the size of their files."""
    from pyspark.sql import functions as F

    from daybars.schemas import COVERAGE
    from daybars.sources import tables

    root, plans, write = f"{tmp_dir}/coverage", [], tables.write_months

    def windows(first, n, answered):
        day = F.lit("2025-01-01").cast("date")
        df = spark.range(first, first + n).select(
            F.col("id").cast("string").alias("code"), day.alias("seg_start"), F.date_add(day, 9).alias("seg_end"),
            F.lit(answered).alias("answered"), F.lit(0).cast("bigint").alias("n_bars"))
        return tables.materialised(df, "windows")

    def seen(df, *args, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, *args, **kw)
    monkeypatch.setattr(tables, "write_months", seen)
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 100, raising=False)
    keys = ["code", "seg_start", "seg_end"]
    for first, n, answered in ((0, 300, False), (200, 101, True), (290, 20, False)):
        tables.merge_months(spark, root, windows(first, n, answered), keys, COVERAGE, date_col="seg_end")
    assert "Broadcast" not in plans[1] and "SortMergeJoin" in plans[1] and "Broadcast" in plans[2]
    stored = {int(r["code"]): r["answered"] for r in tables.read_months(spark, root, COVERAGE).collect()}
    assert stored == {k: 200 <= k < 290 for k in range(310)}
