"""End to end over stored tables: master sync from CP949 files, plan,
landed quotes, collection with late corrections, feature refresh, search."""

import datetime as dt
import os

from pyspark.sql import functions as F

from daybars.adapters import bars_from_events, load, quote_json_lines, quote_records
from daybars.operators.features import features_full
from daybars.plans.jobs import (
    job_collect, job_daily, job_features_full, job_master_counts, job_plan, job_search,
    job_sync_master,
)
from daybars.schemas import BARS, FEATURES, MASTER  # noqa: F401
from daybars.sources.tables import read_months, read_table
from tests.conftest import SF_SMALL, rows
from tests.test_master import line

D = dt.date


def test_end_to_end(spark, tmp_dir):
    # master files: codes 0..149 split over two markets, one code in both
    paths = {}
    for m, codes in [("KOSPI", range(0, 80)), ("KOSDAQ", range(79, 150))]:
        p = os.path.join(tmp_dir, f"{m}.mst")
        with open(p, "wb") as f:
            f.write("\n".join(line(code=str(c), name=f"종목{c}") for c in codes).encode("cp949"))
            f.write(b"\nshort line\n")
        paths[m] = p
    t0 = dt.datetime(2024, 1, 1)
    counts = job_sync_master(spark, paths, f"{tmp_dir}/master", t0,
                             quarantine_root=f"{tmp_dir}/quarantine").first()
    assert (counts["kospi"], counts["kosdaq"], counts["total"]) == (80, 71, 151)
    master = read_table(spark, f"{tmp_dir}/master", MASTER)
    assert master.count() == 150
    assert master.where("code = '79'").first()["market_type"] == "KOSDAQ"
    assert spark.read.parquet(f"{tmp_dir}/quarantine").count() == 2
    assert job_master_counts(spark, f"{tmp_dir}/master").first()["total"] == 150

    # nothing collected yet: every code plans its initial 500 days
    plan = job_plan(spark, f"{tmp_dir}/master", f"{tmp_dir}/bars", "2024-01-30")
    assert plan.count() == 150 * 5

    ev = load(spark, SF_SMALL, "events")
    bars = bars_from_events(ev)
    early = bars_from_events(ev.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")))
    quote_json_lines(quote_records(early, "2024-01-30", 1)).write.text(f"{tmp_dir}/landing1")
    changes, _ = job_collect(spark, f"{tmp_dir}/landing1", f"{tmp_dir}/bars")
    assert changes.count() == early.count()
    job_features_full(spark, f"{tmp_dir}/bars", f"{tmp_dir}/features")
    known = bars.where(F.col("code").cast("int") < 150)

    # a later delivery: new days plus corrected old days
    quote_json_lines(quote_records(bars, "2024-01-30", 2)).write.text(f"{tmp_dir}/landing2")
    summary = job_daily(spark, "2024-01-30", f"{tmp_dir}/master", f"{tmp_dir}/bars",
                        f"{tmp_dir}/features", f"{tmp_dir}/landing2",
                        summary_root=f"{tmp_dir}/summary").first().asDict()
    assert summary["total"] == 150 and sum(v for k, v in summary.items() if k != "total") == 150
    assert rows(read_months(spark, f"{tmp_dir}/bars", BARS).where("cast(code as int) < 150")) == rows(known)
    feats = read_months(spark, f"{tmp_dir}/features", FEATURES)
    assert rows(feats.where("cast(code as int) < 150")) == rows(features_full(known))

    found = job_search(spark, f"{tmp_dir}/master", f"{tmp_dir}/bars", "종목7")
    got = [r["date"] for r in found.collect()]
    assert got == sorted(got, reverse=True) and len(got) == bars.where("code = '7'").count()


def test_sync_master_from_zip_archives(spark, tmp_dir):
    import io
    import zipfile

    paths = {}
    for m, codes in [("KOSPI", ["1", "2"]), ("KOSDAQ", ["2", "3"])]:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr(f"{m.lower()}_code.mst",
                       ("\n".join(line(code=c, name=f"이름{c}") for c in codes) + "\n").encode("cp949"))
        p = os.path.join(tmp_dir, f"{m}.zip")
        with open(p, "wb") as f:
            f.write(buf.getvalue())
        paths[m] = p
    counts = job_sync_master(spark, paths, f"{tmp_dir}/m", dt.datetime(2024, 1, 1), zipped=True,
                             quarantine_root=f"{tmp_dir}/q", run_id="r1").first()
    assert (counts["kospi"], counts["kosdaq"], counts["total"]) == (2, 2, 4)
    got = rows(read_table(spark, f"{tmp_dir}/m", MASTER), "code", "market_type")
    assert got == [("1", "KOSPI"), ("2", "KOSDAQ"), ("3", "KOSDAQ")]
    assert spark.read.parquet(f"{tmp_dir}/q").count() == 0


def test_daily_as_of_only_with_summary(spark, tmp_dir):
    from daybars.operators.features import features_as_of
    from daybars.sources.tables import write_table

    master = spark.createDataFrame([(str(c), f"n{c}", "KOSPI", None, None) for c in range(150)], MASTER)
    write_table(master, f"{tmp_dir}/master")
    ev = load(spark, SF_SMALL, "events")
    bars = bars_from_events(ev)
    early = bars_from_events(ev.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")))
    quote_json_lines(quote_records(early, "2024-01-30", 1)).write.text(f"{tmp_dir}/l1")
    job_collect(spark, f"{tmp_dir}/l1", f"{tmp_dir}/bars", summary_root=f"{tmp_dir}/sum")
    quote_json_lines(quote_records(bars, "2024-01-30", 2)).write.text(f"{tmp_dir}/l2")
    job_daily(spark, "2024-01-30", f"{tmp_dir}/master", f"{tmp_dir}/bars", f"{tmp_dir}/features",
              f"{tmp_dir}/l2", as_of_only=True, summary_root=f"{tmp_dir}/sum")
    got = read_months(spark, f"{tmp_dir}/features", FEATURES)
    # only the as-of date was computed, exactly as the single-date refresh
    assert rows(got) == rows(features_as_of(bars, "2024-01-30"))


def test_features_rebuild_replace_and_keep_unmatched(spark, tmp_dir):
    from daybars.adapters import bars_from_lineitem
    from daybars.sources.tables import changed_months, stored_months, write_months

    bars = bars_from_lineitem(load(spark, SF_SMALL, "lineitem"))
    write_months(bars, f"{tmp_dir}/bars", changed_months(bars), sort_by=["code", "date"])
    stray = spark.createDataFrame([("zz", D(1996, 3, 4), 1.0, 1.0, 1.0, 1.0, 1.0)], FEATURES)
    write_months(stray, f"{tmp_dir}/f", ["1996-03"])
    job_features_full(spark, f"{tmp_dir}/bars", f"{tmp_dir}/f")
    got = read_months(spark, f"{tmp_dir}/f", FEATURES)
    assert rows(got) == rows(features_full(bars))               # replaced
    fs_counts = [len([x for x in os.listdir(f"{tmp_dir}/f/month={m}") if x.startswith("part-")])
                 for m in stored_months(spark, f"{tmp_dir}/f")]
    assert max(fs_counts) <= 2
    # a month whose bars are gone loses its features
    write_months(bars.limit(0), f"{tmp_dir}/bars", ["1996-03"])
    job_features_full(spark, f"{tmp_dir}/bars", f"{tmp_dir}/f")
    left = bars.where("trunc(date, 'month') <> '1996-03-01'")
    assert rows(read_months(spark, f"{tmp_dir}/f", FEATURES)) == rows(features_full(left))
    write_months(stray, f"{tmp_dir}/f2", ["1996-03"])
    job_features_full(spark, f"{tmp_dir}/bars", f"{tmp_dir}/f2", keep_unmatched=True)
    got2 = read_months(spark, f"{tmp_dir}/f2", FEATURES)
    assert rows(got2) == rows(features_full(left).unionByName(stray))


def test_zip_archive_without_the_named_entry_fails(spark, tmp_dir):
    import zipfile

    import pytest
    from pyspark.errors import PythonException

    p = os.path.join(tmp_dir, "K.zip")
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("readme.txt", "stray\n")
        z.writestr("k.mst", (line(code="1", name="이름") + "\n").encode("cp949"))
    counts = job_sync_master(spark, {"KOSPI": p}, f"{tmp_dir}/m", dt.datetime(2024, 1, 1), zipped=True,
                             members={"KOSPI": "k.mst"}, quarantine_root=f"{tmp_dir}/q").first()
    assert counts["total"] == 1 and spark.read.parquet(f"{tmp_dir}/q").count() == 0
    with pytest.raises(PythonException, match="no entry"):
        job_sync_master(spark, {"KOSPI": p}, f"{tmp_dir}/m", dt.datetime(2024, 1, 1), zipped=True,
                        members={"KOSPI": "other.mst"})


def test_rejected_window_is_planned_again(spark, tmp_dir):
    """A window rejected in one run comes back in the next plan although
    a newer window was answered and moved MAX(date) past it."""
    import json

    from daybars.operators.planner import plan_modes
    from daybars.sources.tables import write_table

    master = spark.createDataFrame([("A", "a", "KOSPI", None, None)], MASTER)
    write_table(master, f"{tmp_dir}/m")
    roots = (f"{tmp_dir}/m", f"{tmp_dir}/b")
    plan = job_plan(spark, *roots, "2025-06-30", coverage_root=f"{tmp_dir}/cov")
    windows = sorted((r["seg_start"], r["seg_end"]) for r in plan.collect())
    assert len(windows) == 5

    def land(name, day, outcomes):
        os.makedirs(f"{tmp_dir}/{name}")
        with open(f"{tmp_dir}/{name}/r.json", "w") as f:
            for (a, b), ok in outcomes:
                rec = {"code": "A", "window_start": a.strftime("%Y%m%d"), "window_end": b.strftime("%Y%m%d"),
                       "rt_cd": "0" if ok else "1", "msg1": "", "output2": [{"stck_bsop_date": b.strftime("%Y%m%d")}] if ok else None}
                f.write(json.dumps(rec) + "\n")
        modes = plan_modes(read_table(spark, roots[0], MASTER), read_months(spark, roots[1], BARS), day)
        asked = job_plan(spark, *roots, day, coverage_root=f"{tmp_dir}/cov")
        return job_collect(spark, f"{tmp_dir}/{name}", roots[1], modes, plan=asked, coverage_root=f"{tmp_dir}/cov")[1].first()
    run = land("one", "2025-06-30", [(w, w != windows[2]) for w in windows])
    assert run["partial"] == 1
    again = job_plan(spark, *roots, "2025-07-01", coverage_root=f"{tmp_dir}/cov")
    got = sorted((r["mode"], r["seg_start"], r["seg_end"]) for r in again.collect())
    assert got == [("gap", *windows[2]), ("incremental", D(2025, 7, 1), D(2025, 7, 1))]
    run = land("two", "2025-07-01", [(windows[2], True), ((D(2025, 7, 1), D(2025, 7, 1)), True)])
    assert run["ok"] == 1
    assert job_plan(spark, *roots, "2025-07-01", coverage_root=f"{tmp_dir}/cov").isEmpty()


def test_collect_reads_the_landing_once(spark, tmp_dir, monkeypatch):
    from daybars.operators.planner import plan_incremental, plan_modes
    from daybars.plans import jobs
    from daybars.sources import quotes as QU

    ticks = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def tick(code):
        ticks.add(1)
        return code

    ev = load(spark, SF_SMALL, "events")
    master = spark.createDataFrame([(str(c), f"n{c}", "KOSPI", None, None) for c in range(150)], MASTER)
    bars = bars_from_events(ev)
    quote_json_lines(quote_records(bars, "2024-01-30", 1)).write.text(f"{tmp_dir}/l")
    modes = plan_modes(master, bars.limit(0), "2024-01-30")
    plan = plan_incremental(master, bars.limit(0), "2024-01-30")
    calls = []
    real = QU.read_quotes
    monkeypatch.setattr(jobs, "read_quotes", lambda *a: calls.append(a) or real(*a).withColumn("code", tick("code")))
    _, summary = job_collect(spark, f"{tmp_dir}/l", f"{tmp_dir}/b", modes, plan=plan, quarantine_root=f"{tmp_dir}/q",
                             summary_root=f"{tmp_dir}/s")
    assert summary.first()["total"] == 150
    assert len(calls) == 1 and ticks.value == quote_records(bars, "2024-01-30", 1).count()


def test_second_run_reads_no_json(spark, tmp_dir):
    """With a landing checkpoint every file is read once in its life."""
    from daybars.operators.planner import plan_incremental, plan_modes
    from tests.test_plans import executed

    bars = bars_from_events(load(spark, SF_SMALL, "events"))
    master = spark.createDataFrame([(str(c), f"n{c}", "KOSPI", None, None) for c in range(150)], MASTER)
    modes, plan = plan_modes(master, bars.limit(0), "2024-01-30"), plan_incremental(master, bars.limit(0), "2024-01-30")
    early = bars.where("date < '2024-01-20'")
    args = dict(summary_root=f"{tmp_dir}/s", coverage_root=f"{tmp_dir}/cov", landing_checkpoint=f"{tmp_dir}/ck", plan=plan)
    quote_json_lines(quote_records(early, "2024-01-30", 1)).write.text(f"{tmp_dir}/l/1")
    changes, summary = job_collect(spark, f"{tmp_dir}/l/*", f"{tmp_dir}/b", modes, **args)
    assert rows(changes) == rows(early.select(*changes.columns)) and summary.first()["total"] == 150
    got = []
    read, _ = executed(spark, lambda: got.append(job_collect(spark, f"{tmp_dir}/l/*", f"{tmp_dir}/b", **args)))
    assert got[0][0].count() == 0 and rows(read_months(spark, f"{tmp_dir}/b", BARS)) == rows(early)
    quote_json_lines(quote_records(bars, "2024-01-30", 2)).write.text(f"{tmp_dir}/l/2")
    changes, _ = job_collect(spark, f"{tmp_dir}/l/*", f"{tmp_dir}/b", **args)
    assert rows(changes) == rows(bars.select(*changes.columns))
    assert rows(read_months(spark, f"{tmp_dir}/b", BARS)) == rows(bars)


def test_a_dead_run_is_given_its_files_again(spark, tmp_dir, monkeypatch):
    from daybars.plans import jobs

    bars = bars_from_events(load(spark, SF_SMALL, "events"))
    quote_json_lines(quote_records(bars, "2024-01-30", 1)).write.text(f"{tmp_dir}/l")
    real = jobs.store
    monkeypatch.setattr(jobs, "store", lambda *a: 1 / 0)
    args = (spark, f"{tmp_dir}/l", f"{tmp_dir}/b")
    try:
        job_collect(*args, landing_checkpoint=f"{tmp_dir}/ck")
        raise AssertionError("the run should have died")
    except Exception as e:
        assert "division" in str(e)
    monkeypatch.setattr(jobs, "store", real)
    changes, _ = job_collect(*args, landing_checkpoint=f"{tmp_dir}/ck")
    assert rows(changes) == rows(bars.select(*changes.columns))


def test_plan_reads_one_row_a_code(spark, tmp_dir):
    """The plan from the latest-bar table equals the plan from all bars."""
    from daybars.sources.tables import write_table
    from tests.test_plans import executed

    bars = bars_from_events(load(spark, SF_SMALL, "events"))
    master = spark.createDataFrame([(str(c), f"n{c}", "KOSPI", None, None) for c in range(150)], MASTER)
    write_table(master, f"{tmp_dir}/m")
    for k, part in enumerate((bars.where("date < '2024-01-20'"), bars.where("date >= '2024-01-15'"))):
        quote_json_lines(quote_records(part, "2024-01-30", k)).write.text(f"{tmp_dir}/l{k}")
        job_collect(spark, f"{tmp_dir}/l{k}", f"{tmp_dir}/b", latest_root=f"{tmp_dir}/latest")
    want = rows(job_plan(spark, f"{tmp_dir}/m", f"{tmp_dir}/b", "2024-06-01"))
    got = []
    read, _ = executed(spark, lambda: got.append(rows(job_plan(spark, f"{tmp_dir}/m", f"{tmp_dir}/b", "2024-06-01",
                                                              latest_root=f"{tmp_dir}/latest"))))
    assert got[0] == want
    assert read == 150 + bars.select("code").distinct().count()


def test_search_reads_a_few_row_groups(spark, tmp_dir):
    from daybars.operators.lookup import find_code, find_indexed, name_blocks, name_index
    from daybars.plans.jobs import job_index_names
    from daybars.schemas import NAMES
    from daybars.sources.tables import changed_months, write_months, write_table
    from tests.test_plans import executed

    names = ["Alpha Corp", "ALPHA corp  ", "Café", "cafe", "삼성전자", "Straße", " lead", "lead", "ﬁn", "fin"] + ["Same Name"] * 8 + [f"n{i}" for i in range(500)]
    master = spark.createDataFrame([(f"{i:04d}", n, "KOSPI", None, None) for i, n in enumerate(names)], MASTER)
    write_table(master, f"{tmp_dir}/m", sort_by=["code"])
    job_index_names(spark, f"{tmp_dir}/m", f"{tmp_dir}/names")
    index = read_table(spark, f"{tmp_dir}/names", NAMES)
    small = name_index(read_table(spark, f"{tmp_dir}/m", MASTER), per_block=3)      # equal names fill several blocks
    master = master.coalesce(1).cache()
    for names_table in (index, small):
        names_table = names_table.coalesce(1).cache()
        blocks = name_blocks(names_table).coalesce(1).cache()
        for n, exact in [("alpha CORP", False), ("Alpha Corp", True), ("CAFÉ", False), ("strasse", False), ("fin", False), ("lead", False),
                         ("삼성전자", True), ("same name", False), ("none", False), ("N7 ", False)]:
            assert rows(find_indexed(names_table, blocks, n, exact)) == rows(find_code(master, n, exact))
    plan = find_indexed(index, name_blocks(index), "n7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name_key," in plan
    bars = bars_from_events(load(spark, SF_SMALL, "events"))
    code = F.lpad("code", 4, "0")
    wanted = names[int(bars.agg(F.max(F.col("code").cast("int"))).first()[0])]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_months(bars.withColumn("code", code), f"{tmp_dir}/b", changed_months(bars), sort_by=["code", "date"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = []
    read, _ = executed(spark, lambda: got.append(job_search(spark, f"{tmp_dir}/m", f"{tmp_dir}/b", wanted,
                                                           names_root=f"{tmp_dir}/names").collect()))
    own = bars.where(code == got[0][0]["code"]).count()
    assert len(got[0]) == own > 0
    # whole row groups: those of the code's file and of the name's, not the tables
    assert read < bars.count() / 2 + 600
