"""Registered queries over the driver's tables, each with a DuckDB oracle.

Every query reads whole driver tables (``customer``, ``events``) through the
adapters, so its work grows with the scale factor. Parameters below are
fixed so that Spark and the oracle compute the same thing.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybars import adapters as A
from daybars.operators import aggregates as AG
from daybars.operators import features as FE
from daybars.operators import integrity as IN
from daybars.operators import keyed as KY
from daybars.operators import lookup as LK
from daybars.operators import planner as PL
from daybars.schemas import BAR_VALUES
from daybars.sources import master_text as MT
from daybars.sources import quotes as QU

# Fixed parameters of the registered queries.
AS_OF_FEATURES = "2024-01-15"      # features_as_of, prev_bar_asof
AS_OF_PLAN = "2024-06-01"          # plan_initial, plan_incremental (multi-window)
AS_OF_MODES = "2024-01-30"         # plan_modes (has up-to-date codes)
KNOWN_TS = "2024-01-06 00:00:00"   # collection runs: events before this instant are stored already
AS_OF_RUN = "2024-04-25"           # ... and a window ends inside January
AS_OF_LATER = "2024-05-10"         # plan_after_failures
AS_OF_BACKFILL = "2024-09-20"      # job_backfill: its range starts inside the bars
BACKFILL_DAYS = 250                # plan_full
SPLIT_TS = "2024-01-21 00:00:00"   # base bars: events before this instant
CHANGE_TS = "2024-01-15 00:00:00"  # change set: events from this instant
LOOKUP_NAME = "customer#000000007"  # case differs from the stored name
RUN_TS = "2024-02-01 00:00:00"
BASE_TS = "2024-01-01 00:00:00"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
REMOVED_SEGMENT = "HOUSEHOLD"


# ---------------------------------------------------------------- inputs
def _master(spark, d):
    return A.master_from_customer(A.load(spark, d, "customer"))


def _events(spark, d):
    return A.load(spark, d, "events")


def _bars(spark, d):
    return A.bars_from_events(_events(spark, d))


def _base_bars(spark, d):
    return A.bars_from_events(_events(spark, d).where(F.col("ts") < A.ts_ntz(SPLIT_TS)))


def _change_bars(spark, d):
    return A.bars_from_events(_events(spark, d).where(F.col("ts") >= A.ts_ntz(CHANGE_TS)))


def _bars_cols(df):
    return df.select("code", "date", "open", "high", "low", "close", "volume")


# ---------------------------------------------------------------- queries
def q_bars_daily(spark, d):
    return _bars(spark, d)


def q_master_project(spark, d):
    return _master(spark, d)


def q_master_union_markets(spark, d):
    """Customers of nation 0 are listed in their own market and in the last
    one, which must win."""
    c = A.load(spark, d, "customer")
    m = A.master_from_customer(c)
    both = A.master_from_customer(c.where(F.col("c_nationkey") == 0)).withColumn("market_type", F.lit(SEGMENTS[-1]))
    listed = m.unionByName(both)
    per_market = [listed.where(F.col("market_type") == s).select("code", "name", F.lit(s).alias("market_type"))
                  for s in SEGMENTS]
    u = MT.union_markets(per_market)
    return KY.keep_last(u, ["code"], "_prio").drop("_prio")


def q_master_fixed_width(spark, d):
    lines = A.master_lines(_master(spark, d))
    parts = [MT.parse_master_lines(lines.where(F.col("market_type") == s).select("line"), s)
             for s in SEGMENTS]
    return reduce(DataFrame.unionByName, parts)


def _dirty(e):
    """Text the lenient parsers must cope with: numbers with a tail, decimals
    where an integer is due, and no number at all for quiet days."""
    quiet = e["acml_vol"] == "0"
    return (e.withField("stck_clpr", F.concat(e["stck_clpr"], F.lit(" won")))
             .withField("stck_oprc", F.when(quiet, F.lit("n/a")).otherwise(e["stck_oprc"]))
             .withField("acml_vol", F.concat(e["acml_vol"], F.lit(".9"))))


def q_quotes_parse(spark, d):
    """Every window is fetched twice; the first answer has prices of 1."""
    bars = _bars(spark, d)
    old = A.quote_records(bars.withColumns({c: F.lit(1.0) for c in ("open", "high", "low", "close")}), AS_OF_MODES, 1)
    new = A.quote_records(bars, AS_OF_MODES, 2)
    recs = old.unionByName(new.withColumn("output2", F.transform("output2", _dirty)))
    parsed = QU.parse_quotes(A.from_json_lines(A.quote_json_lines(recs)))
    return _bars_cols(KY.keep_last(parsed, ["code", "date"], "seq"))


def q_date_roundtrip(spark, d):
    from daybars.functions.parse import format_yyyymmdd, parse_yyyymmdd
    b = _bars(spark, d)
    return b.select("code", "date", format_yyyymmdd("date").alias("ymd"),
                    parse_yyyymmdd(format_yyyymmdd("date")).alias("date_back"))


def q_count_by_market(spark, d):
    return AG.count_by_market(_master(spark, d))


def q_latest_bar(spark, d):
    return AG.latest_bar(_bars(spark, d))


def q_lookup_by_name(spark, d):
    return LK.lookup_bars(_master(spark, d), _bars(spark, d), LOOKUP_NAME)


def q_dedupe_last(spark, d):
    ev = _events(spark, d)
    raw = ev.select(F.col("user_id").cast("string").alias("code"), F.to_date("ts").alias("date"),
                    F.col("value").alias("price"),
                    (F.col("event_type") == "purchase").cast("bigint").alias("volume"),
                    F.col("event_id").alias("seq"))
    return KY.keep_last(raw, ["code", "date"], "seq")


def q_upsert_prices(spark, d):
    return KY.upsert(_base_bars(spark, d), _change_bars(spark, d), ["code", "date"])


def q_upsert_master(spark, d):
    c = A.load(spark, d, "customer")
    base = (A.master_from_customer(c.where(F.col("c_nationkey") < 13))
            .withColumn("created_at", A.ts_ntz(BASE_TS))
            .withColumn("updated_at", A.ts_ntz(BASE_TS)))
    ch = (A.master_from_customer(c.where(F.col("c_nationkey") >= 10))
          .withColumn("name", F.upper("name")))
    return KY.upsert_with_audit(base, ch, ["code"], A.ts_ntz(RUN_TS))


def q_upsert_features(spark, d):
    base = FE.features_full(_base_bars(spark, d))
    new = FE.features_full(_bars(spark, d)).where(F.col("date") >= F.lit(_dt.date(2024, 1, 15)))
    return KY.upsert(base, new, ["code", "date"])


def q_plan_full(spark, d):
    return PL.plan_full(_master(spark, d), AS_OF_MODES, BACKFILL_DAYS)


def q_plan_initial(spark, d):
    return PL.plan_initial(_master(spark, d), _bars(spark, d), AS_OF_PLAN)


def q_plan_incremental(spark, d):
    return PL.plan_incremental(_master(spark, d), _bars(spark, d), AS_OF_PLAN)


def q_plan_modes(spark, d):
    return PL.plan_mode_counts(_master(spark, d), _bars(spark, d), AS_OF_MODES)


def q_prev_bar_asof(spark, d):
    return FE.prev_bar(_bars(spark, d), AS_OF_FEATURES)


def q_features_full(spark, d):
    return FE.features_full(_bars(spark, d))


def q_features_as_of(spark, d):
    return FE.features_as_of(_bars(spark, d), AS_OF_FEATURES)


def q_features_touched(spark, d):
    base = _base_bars(spark, d)
    changes = _change_bars(spark, d)
    merged = KY.upsert(base, changes, ["code", "date"])
    return FE.features_touched(FE.features_full(base), merged, changes)


def _live_master(spark, d):
    return _master(spark, d).where(F.col("market_type") != REMOVED_SEGMENT)


def q_fk_valid(spark, d):
    return IN.fk_valid(_bars(spark, d), _live_master(spark, d))


def q_fk_orphans(spark, d):
    return IN.fk_orphans(_bars(spark, d), _live_master(spark, d))


def q_cascade_delete(spark, d):
    removed = _master(spark, d).where(F.col("market_type") == REMOVED_SEGMENT)
    return KY.cascade_delete(FE.features_full(_bars(spark, d)), removed)


def q_quality_report(spark, d):
    bars = _bars(spark, d)
    return IN.quality_report(_master(spark, d), bars, FE.features_full(bars), markets=SEGMENTS)


def _known(spark, d):
    """Bars that are there before a collection run."""
    return A.bars_from_events(_events(spark, d).where(F.col("ts") < A.ts_ntz(KNOWN_TS)))


def _run_inputs(spark, d, as_of):
    """Modes, plan and landed responses of a run in which every market meets
    another fate: AUTOMOBILE is rejected and then answered (its second window
    stays rejected), BUILDING is not answered, FURNITURE is answered with
    unreadable dates, HOUSEHOLD is rejected, MACHINERY is answered."""
    master, bars = _master(spark, d), _bars(spark, d)
    modes = PL.plan_modes(master, _known(spark, d), as_of)
    plan = PL.plan_incremental(master, _known(spark, d), as_of)
    end = F.lit(_dt.date.fromisoformat(as_of))
    # the window of a bar is arithmetic: windows are counted back from as_of
    i = F.floor(F.datediff(end, F.col("date")) / PL.WINDOW_DAYS).cast("int")
    element = F.struct(F.date_format("date", "yyyyMMdd").alias("stck_bsop_date"), *[
        F.col(c).cast("string").alias(n) for c, n in (("open", "stck_oprc"), ("high", "stck_hgpr"), ("low", "stck_lwpr"),
                                                      ("close", "stck_clpr"), ("volume", "acml_vol"))])
    found = (bars.join(modes.select("code", "start"), "code").where((F.col("date") >= F.col("start")) & (F.col("date") <= end))
                 .groupBy("code", i.alias("i")).agg(F.array_sort(F.collect_list(element)).alias("output2")))
    w = plan.join(_segments(master), "code").join(found, ["code", "i"], "left").withColumn(
        "output2", F.coalesce("output2", F.array().cast(found.schema["output2"].dataType)))
    garbled = F.transform("output2", lambda e: e.withField("stck_bsop_date", F.lit("not a date")))

    def answer(rows, seq, rejected=False, output=F.col("output2")):
        return rows.select(
            "code", F.date_format("seg_start", "yyyyMMdd").alias("window_start"),
            F.date_format("seg_end", "yyyyMMdd").alias("window_end"), F.lit(seq).cast("bigint").alias("fetch_seq"),
            F.lit("1" if rejected else "0").alias("rt_cd"), F.lit("busy" if rejected else "OK").alias("msg1"),
            (F.lit(None).cast(found.schema["output2"].dataType) if rejected else output).alias("output2"))
    seg, second = F.col("_seg"), F.col("i") == 1
    responses = reduce(DataFrame.unionByName, [
        answer(w.where(seg == "AUTOMOBILE"), 1, rejected=True),
        answer(w.where((seg == "AUTOMOBILE") & ~second), 2),
        answer(w.where(seg == "FURNITURE"), 1, output=garbled),
        answer(w.where(seg == "HOUSEHOLD"), 1, rejected=True),
        answer(w.where(seg == "MACHINERY"), 1)])
    return modes, plan, responses


def _code_status(spark, d, as_of):
    modes, plan, responses = _run_inputs(spark, d, as_of)
    parsed = QU.parse_responses(A.from_json_lines(A.quote_json_lines(responses)))
    return AG.code_status(modes, plan, QU.answers_of(parsed))


def q_run_summary(spark, d):
    return AG.run_summary(_code_status(spark, d, AS_OF_RUN))


def q_collected_range(spark, d):
    return AG.collected_range(_bars(spark, d))


def q_stream_catchup(spark, d):
    """Two deliveries; the first has preliminary bars (without purchase
    events), the later one the final bars, whose values must win. The bars
    table after the stream has drained equals the final bars."""
    from daybars.schemas import BARS as BARS_SCHEMA
    from daybars.session import scratch_dir
    from daybars.sources.tables import read_months
    from daybars.streaming.catchup import start_catchup

    root = scratch_dir(spark, "catchup")
    prelim = A.bars_from_events(_events(spark, d).where(F.col("event_type") != "purchase"))
    A.quote_json_lines(A.quote_records(prelim, AS_OF_MODES, 1)).write.text(f"{root}/landing/delivery-0001")
    A.quote_json_lines(A.quote_records(_bars(spark, d), AS_OF_MODES, 2)).write.text(f"{root}/landing/delivery-0002")
    q = start_catchup(spark, f"{root}/landing/*", f"{root}/bars", f"{root}/stream-checkpoint",
                      features_root=f"{root}/features", summary_root=f"{root}/summary")
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_months(spark, f"{root}/bars", BARS_SCHEMA)


def q_master_quarantine(spark, d):
    """Fixed-width lines rendered from customer where negative balances lose
    their name field (empty name range) and nation 0 has a blank name; the
    parser must quarantine exactly those lines, per market."""
    c = A.load(spark, d, "customer")
    m = c.select(F.col("c_custkey").cast("string").alias("code"),
                 F.when(F.col("c_nationkey") == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("name"),
                 F.col("c_mktsegment").alias("market_type"), "c_acctbal")
    lines = A.master_lines(m, keep=["c_acctbal"])
    no_name = F.concat(F.substring("line", 1, 21), F.substring("line", -MT.TAIL_WIDTH, MT.TAIL_WIDTH))
    lines = lines.select(F.when(F.col("c_acctbal") < 0, no_name).otherwise(F.col("line")).alias("line"),
                         "market_type")
    bad = [MT.split_master_lines(lines.where(F.col("market_type") == s).select("line"), s)[1]
           for s in SEGMENTS]
    return reduce(DataFrame.unionByName, bad).select("code", "reason")


def _segments(master):
    return master.select("code", F.col("market_type").alias("_seg"))


def q_quotes_quarantine(spark, d):
    """Responses rendered from bars: HOUSEHOLD codes are answered with a
    reject, and zero-volume bars carry a malformed date (day 00)."""
    recs = A.quote_records(_bars(spark, d), AS_OF_MODES).join(_segments(_master(spark, d)), "code", "left")
    closed = F.col("_seg") == REMOVED_SEGMENT
    day00 = lambda e: e.withField(
        "stck_bsop_date",
        F.when(e["acml_vol"] == "0", F.concat(F.substring(e["stck_bsop_date"], 1, 6), F.lit("00")))
         .otherwise(e["stck_bsop_date"]))
    fixed = recs.select(
        "code", "window_start", "window_end", "fetch_seq",
        F.when(closed, F.lit("1")).otherwise(F.col("rt_cd")).alias("rt_cd"),
        F.when(closed, F.lit("segment closed")).otherwise(F.col("msg1")).alias("msg1"),
        F.when(closed, F.lit(None)).otherwise(F.transform("output2", day00)).alias("output2"))
    _, bad = QU.split_quotes(A.from_json_lines(A.quote_json_lines(fixed)))
    return bad.select("code", "window_start", "window_end", "reason")


def q_code_status_rejects(spark, d):
    """Per-code outcome of the run of :func:`_run_inputs`."""
    return _code_status(spark, d, AS_OF_RUN)


def q_quotes_accounting(spark, d):
    """Landed files in which HOUSEHOLD responses carry no code and FURNITURE
    lines are cut off: every element (and every cut line) ends up as a bar or
    in the quarantine. Rows by outcome."""
    from daybars.session import scratch_dir

    path = scratch_dir(spark, "accounting")
    recs = A.quote_records(_bars(spark, d), AS_OF_MODES).join(_segments(_master(spark, d)), "code", "left")
    recs = recs.withColumn("code", F.when(F.coalesce(F.col("_seg") != "HOUSEHOLD", F.lit(True)), F.col("code")))
    line = F.to_json(F.struct("code", "window_start", "window_end", "fetch_seq", "rt_cd", "msg1", "output2"))
    cut = F.when(F.col("_seg") == "FURNITURE", F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line)
    recs.select(cut.alias("value")).write.text(path)
    parsed = QU.stage(QU.parse_responses(QU.read_quotes(spark, path)))
    bars, bad = QU.bars_of(parsed), QU.quarantine_of(parsed)
    n = F.count(F.lit(1)).alias("n")
    return bars.groupBy(F.lit("bar").alias("outcome")).agg(n).unionByName(
        bad.groupBy(F.col("reason").alias("outcome")).agg(n))


def q_features_full_lineitem(spark, d):
    return FE.features_full(A.bars_from_lineitem(A.load(spark, d, "lineitem")))


def q_market_counts_wide(spark, d):
    return AG.market_counts_wide(_master(spark, d), SEGMENTS)



def q_job_sync_master(spark, d):
    """C1 end to end: every segment's master lines, with Korean names, written
    as CP949 files, then parsed and upserted by the sync job."""
    from daybars.plans.jobs import job_sync_master
    from daybars.schemas import MASTER
    from daybars.session import checkpoint_dir, scratch_dir
    from daybars.sources.tables import read_table

    checkpoint_dir(spark)
    root = scratch_dir(spark, "sync-master")
    korean = F.concat(F.lit("고객 "), F.substring("name", 10, 100))
    lines = A.master_lines(_master(spark, d).withColumn("name", korean))
    paths = {}
    for s in SEGMENTS:
        p = f"{root}/landing/{s.lower()}.mst"
        (lines.where(F.col("market_type") == s).select("line").write
              .option("encoding", MT.CHARSET).option("sep", "\u0001").option("quote", "")
              .option("lineSep", "\n").csv(p))
        paths[s] = p
    job_sync_master(spark, paths, f"{root}/master", A.ts_ntz(RUN_TS))
    return read_table(spark, f"{root}/master", MASTER)


def _stored(spark, d, name):
    """Roots of a run's tables, with the whole master stored."""
    from daybars.session import checkpoint_dir, scratch_dir
    from daybars.sources.tables import write_table

    checkpoint_dir(spark)
    root = scratch_dir(spark, name)
    t = {k: f"{root}/{k}" for k in ("master", "bars", "features", "summary", "coverage", "quarantine", "landing1", "landing2")}
    none = F.lit(None).cast("timestamp_ntz")
    write_table(_master(spark, d).withColumn("created_at", none).withColumn("updated_at", none), t["master"])
    return t


def _first_load(spark, d, t):
    """The base bars landed and collected, features rebuilt."""
    from daybars.plans.jobs import job_collect, job_features_full

    A.quote_json_lines(A.quote_records(_base_bars(spark, d), AS_OF_MODES, 1)).write.text(t["landing1"])
    job_collect(spark, t["landing1"], t["bars"], summary_root=t["summary"])
    job_features_full(spark, t["bars"], t["features"])


def q_job_daily_features(spark, d):
    """C2 + C4 + C5 end to end on month-partitioned tables: a first landing
    (events before SPLIT_TS) is collected and features are rebuilt; a second
    landing (all bars, later) is applied by the daily job, which refreshes
    only the touched months from the maintained month summary. Returns the
    features table."""
    from daybars.plans.jobs import job_daily
    from daybars.schemas import FEATURES
    from daybars.sources.tables import read_months

    t = _stored(spark, d, "daily")
    _first_load(spark, d, t)
    A.quote_json_lines(A.quote_records(_bars(spark, d), AS_OF_MODES, 2)).write.text(t["landing2"])
    job_daily(spark, AS_OF_MODES, t["master"], t["bars"], t["features"], t["landing2"], summary_root=t["summary"])
    return read_months(spark, t["features"], FEATURES)


def q_job_daily_orphans(spark, d):
    """The daily job against a master without one market: its bars are not
    stored but quarantined. Returns stored and quarantined rows by code."""
    from daybars.plans.jobs import job_daily, job_remove_codes
    from daybars.schemas import BARS as BARS_SCHEMA
    from daybars.sources.tables import read_months

    t = _stored(spark, d, "orphans")
    gone = _master(spark, d).where(F.col("market_type") == REMOVED_SEGMENT)
    job_remove_codes(spark, gone, t["master"], t["bars"], t["features"], t["summary"])
    A.quote_json_lines(A.quote_records(_bars(spark, d), AS_OF_MODES, 1)).write.text(t["landing1"])
    job_daily(spark, AS_OF_MODES, t["master"], t["bars"], t["features"], t["landing1"],
              quarantine_root=t["quarantine"], run_id="r1", summary_root=t["summary"])
    n = F.count(F.lit(1)).alias("n")
    bad = spark.read.parquet(t["quarantine"]).groupBy("code", F.col("reason").alias("outcome")).agg(n)
    kept = read_months(spark, t["bars"], BARS_SCHEMA).groupBy("code", F.lit("stored").alias("outcome")).agg(n)
    return kept.unionByName(bad)


def q_job_remove_codes(spark, d):
    """ON DELETE CASCADE: one market's codes leave master, bars, summary and
    features. Returns the features that are left."""
    from daybars.plans.jobs import job_remove_codes
    from daybars.schemas import FEATURES
    from daybars.sources.tables import read_months

    t = _stored(spark, d, "remove")
    _first_load(spark, d, t)
    gone = _master(spark, d).where(F.col("market_type") == REMOVED_SEGMENT)
    job_remove_codes(spark, gone, t["master"], t["bars"], t["features"], t["summary"])
    return read_months(spark, t["features"], FEATURES)


def q_job_backfill(spark, d):
    """C3 end to end: the windows of a full backfill are planned, answered
    and collected. Returns the bars table."""
    from daybars.plans.jobs import job_collect, job_plan
    from daybars.schemas import BARS as BARS_SCHEMA
    from daybars.sources.tables import read_months

    t = _stored(spark, d, "backfill")
    plan = job_plan(spark, t["master"], t["bars"], AS_OF_BACKFILL, days=BACKFILL_DAYS)
    wanted = plan.select("code", "seg_start", "seg_end")
    bars = _bars(spark, d).join(wanted, "code").where("date BETWEEN seg_start AND seg_end").select(
        "code", "date", "open", "high", "low", "close", "volume")
    A.quote_json_lines(A.quote_records(bars, AS_OF_BACKFILL, 1)).write.text(t["landing1"])
    job_collect(spark, t["landing1"], t["bars"], master_root=t["master"], quarantine_root=t["quarantine"])
    return read_months(spark, t["bars"], BARS_SCHEMA)


def q_plan_after_failures(spark, d):
    """The run of :func:`_run_inputs` is collected with coverage; the
    plan of a later day asks again for every window that failed, also where
    newer bars have moved past it."""
    from daybars.plans.jobs import job_collect, job_plan

    t = _stored(spark, d, "replan")
    A.quote_json_lines(A.quote_records(_known(spark, d), AS_OF_MODES, 1)).write.text(t["landing1"])
    job_collect(spark, t["landing1"], t["bars"])
    modes, plan, responses = _run_inputs(spark, d, AS_OF_RUN)
    for seq in (1, 2):          # retries land after what they repeat
        A.quote_json_lines(responses.where(F.col("fetch_seq") == seq)).write.text(f"{t['landing2']}/{seq}")
    job_collect(spark, f"{t['landing2']}/*", t["bars"], modes, plan=plan, coverage_root=t["coverage"])
    return job_plan(spark, t["master"], t["bars"], AS_OF_LATER, coverage_root=t["coverage"]).where(F.col("mode") == "gap")


def q_plan_gaps(spark, d):
    """Coverage-based re-plan: required ranges from the incremental plan at
    AS_OF_PLAN, coverage = the windows of all codes but the rejected ones
    (HOUSEHOLD, and AUTOMOBILE's second window); the gaps are exactly the
    rejected windows, re-cut from each gap's end."""
    master = _master(spark, d)
    modes = PL.plan_modes(master, _base_bars(spark, d), AS_OF_PLAN).where(F.col("mode") != "skip")
    plan = PL.plan_incremental(master, _base_bars(spark, d), AS_OF_PLAN).join(_segments(master), "code", "left")
    rejected = (F.col("_seg") == REMOVED_SEGMENT) | ((F.col("_seg") == "AUTOMOBILE") & (F.col("i") == 1))
    coverage = plan.where(~rejected).select("code", "seg_start", "seg_end")
    return PL.gap_windows(modes, coverage)


def _faulty(spark, d):
    """Master, bars and features with every fault the checks look for."""
    c = A.load(spark, d, "customer")
    seg = F.col("market_type")
    m = A.master_from_customer(c)
    m = m.unionByName(m.where(seg == "BUILDING")).select(
        F.when(seg == "MACHINERY", F.concat(F.lit("x" * 10), "code")).otherwise(F.col("code")).alias("code"),
        F.when(seg == "FURNITURE", None).when(seg == "HOUSEHOLD", F.repeat("name", 6)).otherwise(F.col("name")).alias("name"),
        F.when(seg == "AUTOMOBILE", F.lit("AUTOMOBILES")).otherwise(seg).alias("market_type"))
    m = m.unionByName(m.where(F.col("name").isNull()).select(F.lit(None).cast("string").alias("code"), "name",
                                                              F.lit(None).cast("string").alias("market_type")))
    b = _bars(spark, d)
    quiet = F.col("volume") == 0
    b = b.unionByName(b.where(quiet)).select(
        F.when(F.col("volume") == 2, F.concat(F.lit("y" * 10), "code")).when(F.col("volume") == 3, None).otherwise(F.col("code")).alias("code"),
        F.when(F.col("volume") >= 3, None).otherwise(F.col("date")).alias("date"),
        *[F.when(quiet, None).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low", "close")],
        F.when(F.col("volume") == 1, None).otherwise(F.col("volume")).alias("volume"))
    f = FE.features_full(_bars(spark, d))
    up = F.col("close_change_rate") > 0
    f = f.unionByName(f.where(up)).select(
        F.when(F.col("open_change_rate") > 500, F.concat(F.lit("z" * 10), "code"))
         .when(F.col("open_change_rate") < -90, None).otherwise(F.col("code")).alias("code"),
        F.when(F.col("high_change_rate") < -80, None).otherwise(F.col("date")).alias("date"),
        *[F.when(up, None).otherwise(F.col(f"{c}_change_rate")).alias(f"{c}_change_rate") for c in BAR_VALUES])
    return m, b, f


def q_quality_faults(spark, d):
    return IN.quality_report(*_faulty(spark, d), markets=SEGMENTS)


def q_month_summary(spark, d):
    """Last bar of every (code, month), over the multi-year lineitem bars:
    the summary that replaces history scans in the daily path."""
    return FE.month_summary(A.bars_from_lineitem(A.load(spark, d, "lineitem")))


def q_features_as_of_summary(spark, d):
    """Single-date features from the month summary plus the bars of the
    as-of month (no history scan); must equal ``features_as_of``."""
    bars = _bars(spark, d)
    as_of = _dt.date.fromisoformat(AS_OF_FEATURES)
    month = bars.where(F.trunc("date", "month") == F.lit(as_of.replace(day=1)))
    return FE.features_as_of_summary(FE.month_summary(bars), month, as_of)



def q_features_touched_summary(spark, d):
    """``features_touched`` with the month summary of the merged bars in
    place of their per-month scan; must equal the full recompute."""
    base = _base_bars(spark, d)
    changes = _change_bars(spark, d)
    merged = KY.upsert(base, changes, ["code", "date"])
    return FE.features_touched(FE.features_full(base), merged, changes,
                               summary=FE.month_summary(merged))


QUERIES = {
    "bars_daily": q_bars_daily,
    "master_project": q_master_project,
    "master_union_markets": q_master_union_markets,
    "master_fixed_width": q_master_fixed_width,
    "quotes_parse": q_quotes_parse,
    "date_roundtrip": q_date_roundtrip,
    "count_by_market": q_count_by_market,
    "latest_bar": q_latest_bar,
    "lookup_by_name": q_lookup_by_name,
    "dedupe_last": q_dedupe_last,
    "upsert_prices": q_upsert_prices,
    "upsert_master": q_upsert_master,
    "upsert_features": q_upsert_features,
    "plan_full": q_plan_full,
    "plan_initial": q_plan_initial,
    "plan_incremental": q_plan_incremental,
    "plan_modes": q_plan_modes,
    "prev_bar_asof": q_prev_bar_asof,
    "features_full": q_features_full,
    "features_as_of": q_features_as_of,
    "features_touched": q_features_touched,
    "fk_valid": q_fk_valid,
    "fk_orphans": q_fk_orphans,
    "cascade_delete": q_cascade_delete,
    "quality_report": q_quality_report,
    "run_summary": q_run_summary,
    "collected_range": q_collected_range,
    "stream_catchup": q_stream_catchup,
    "master_quarantine": q_master_quarantine,
    "quotes_quarantine": q_quotes_quarantine,
    "code_status_rejects": q_code_status_rejects,
    "features_full_lineitem": q_features_full_lineitem,
    "market_counts_wide": q_market_counts_wide,
    "job_sync_master": q_job_sync_master,
    "job_daily_features": q_job_daily_features,
    "plan_gaps": q_plan_gaps,
    "month_summary": q_month_summary,
    "features_as_of_summary": q_features_as_of_summary,
    "features_touched_summary": q_features_touched_summary,
    "quotes_accounting": q_quotes_accounting,
    "quality_faults": q_quality_faults,
    "job_daily_orphans": q_job_daily_orphans,
    "job_remove_codes": q_job_remove_codes,
    "job_backfill": q_job_backfill,
    "plan_after_failures": q_plan_after_failures,
}


# ---------------------------------------------------------------- oracle SQL
def _bars_sql(where: str = "") -> str:
    w = f"WHERE {where}" if where else ""
    return f"""
    SELECT CAST(user_id AS VARCHAR) AS code, CAST(ts AS DATE) AS "date",
           arg_min("value", (ts, event_id)) AS "open",
           max("value") AS high,
           min("value") AS low,
           arg_max("value", (ts, event_id)) AS "close",
           count(*) FILTER (WHERE event_type = 'purchase') AS volume
    FROM events {w}
    GROUP BY 1, 2"""


BARS = _bars_sql()
BASE_BARS = _bars_sql(f"ts < TIMESTAMP '{SPLIT_TS}'")
CHANGE_BARS = _bars_sql(f"ts >= TIMESTAMP '{CHANGE_TS}'")
MASTER = """SELECT CAST(c_custkey AS VARCHAR) AS code, c_name AS name,
                   c_mktsegment AS market_type FROM customer"""


def _features_sql(bars_cte: str) -> str:
    lags = ", ".join(f'LAG("{c}") OVER w AS prev_{c}' for c in BAR_VALUES)
    rates = ", ".join(f'(("{c}" - prev_{c}) / NULLIF(prev_{c}, 0)) * 100 AS {c}_change_rate'
                      for c in BAR_VALUES)
    return f"""
    SELECT code, "date", {rates}
    FROM (SELECT code, "date", "open", "close", high, low, volume, {lags}
          FROM ({bars_cte}) b
          WINDOW w AS (PARTITION BY code ORDER BY "date")) src
    WHERE prev_close IS NOT NULL"""


def _upsert_sql(base: str, ch: str, keys=("code", "date")) -> str:
    on = " AND ".join(f'c."{k}" = b."{k}"' for k in keys)
    return f"""
    WITH base AS ({base}), ch AS ({ch})
    SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM ch c WHERE {on})
    UNION ALL SELECT * FROM ch"""


def _plan_sql(as_of: str, mode_filter: str, bars: str = BARS) -> str:
    return f"""
    WITH lt AS (SELECT code, max("date") AS latest FROM ({bars}) b GROUP BY code),
    r AS (
      SELECT m.code,
             CASE WHEN lt.latest IS NULL THEN 'initial'
                  WHEN lt.latest + 1 > DATE '{as_of}' THEN 'skip'
                  ELSE 'incremental' END AS mode,
             CASE WHEN lt.latest IS NULL THEN DATE '{as_of}' - 499
                  ELSE lt.latest + 1 END AS start
      FROM ({MASTER}) m LEFT JOIN lt ON m.code = lt.code),
    x AS (
      SELECT code, mode, start,
             unnest(range(0, CAST(ceil((DATE '{as_of}' - start + 1) / 100.0) AS BIGINT))) AS i
      FROM r WHERE {mode_filter})
    SELECT code, mode, CAST(i AS INTEGER) AS i,
           greatest(DATE '{as_of}' - CAST(i * 100 + 99 AS INTEGER), start) AS seg_start,
           DATE '{as_of}' - CAST(i * 100 AS INTEGER) AS seg_end
    FROM x"""


def _quality_sql(master: str, bars: str, feats: str) -> str:
    seg = ", ".join(f"'{s}'" for s in SEGMENTS)

    def checks(tbl, src, not_null, lengths=None, domain=None):
        parts = [f"SELECT '{tbl}' AS tbl, 'null_{c}' AS check_name, "
                 f"CAST(count(*) FILTER (WHERE \"{c}\" IS NULL) AS BIGINT) AS n_bad FROM ({src}) t"
                 for c in not_null]
        for c, n in (lengths or {}).items():
            parts.append(f"SELECT '{tbl}', 'len_{c}', CAST(count(*) FILTER (WHERE length({c}) > {n}) AS BIGINT) FROM ({src}) t")
        if domain:
            parts.append(f"SELECT '{tbl}', 'domain_{domain}', CAST(count(*) FILTER (WHERE {domain} NOT IN ({seg})) AS BIGINT) FROM ({src}) t")
        return parts

    def dup(tbl, src, keys):
        k = ", ".join(f'"{x}"' for x in keys)
        return (f"SELECT '{tbl}' AS tbl, 'dup_{'_'.join(keys)}' AS check_name, CAST(count(*) AS BIGINT) AS n_bad FROM "
                f"(SELECT {k} FROM ({src}) t GROUP BY {k} HAVING count(*) > 1) d")

    def orphans(tbl, src):
        return (f"SELECT '{tbl}', 'orphan_code', CAST(count(*) AS BIGINT) FROM ({src}) t "
                f"WHERE NOT EXISTS (SELECT 1 FROM ({master}) m WHERE m.code = t.code)")

    parts = [dup("master", master, ["code"])]
    parts += checks("master", master, ["code", "name", "market_type"],
                    {"code": 10, "name": 100, "market_type": 10}, "market_type")
    parts += [dup("bars", bars, ["code", "date"])]
    parts += checks("bars", bars, ["code", "date", "open", "high", "low", "close", "volume"], {"code": 10})
    parts += [orphans("bars", bars), dup("features", feats, ["code", "date"])]
    parts += checks("features", feats, ["code", "date"], {"code": 10})
    parts += checks("features", feats, ["open_change_rate", "close_change_rate",
                                        "high_change_rate", "low_change_rate"])
    parts += [orphans("features", feats)]
    return "\nUNION ALL\n".join(parts)


def _faulty_sql() -> tuple[str, str, str]:
    m = f"""
    SELECT CASE market_type WHEN 'MACHINERY' THEN repeat('x', 10) || code ELSE code END AS code,
           CASE market_type WHEN 'FURNITURE' THEN NULL WHEN 'HOUSEHOLD' THEN repeat(name, 6) ELSE name END AS name,
           CASE market_type WHEN 'AUTOMOBILE' THEN 'AUTOMOBILES' ELSE market_type END AS market_type
    FROM ({MASTER}) m, range(1, CASE market_type WHEN 'BUILDING' THEN 3 ELSE 2 END) r
    UNION ALL
    SELECT NULL, NULL, NULL FROM customer WHERE c_mktsegment = 'FURNITURE'"""
    price = ", ".join(f'CASE WHEN volume = 0 THEN NULL ELSE "{c}" END AS "{c}"' for c in ("open", "high", "low", "close"))
    b = f"""
    SELECT CASE volume WHEN 2 THEN repeat('y', 10) || code WHEN 3 THEN NULL ELSE code END AS code,
           CASE WHEN volume >= 3 THEN NULL ELSE "date" END AS "date", {price},
           CASE volume WHEN 1 THEN NULL ELSE volume END AS volume
    FROM ({BARS}) b, range(1, CASE volume WHEN 0 THEN 3 ELSE 2 END) r"""
    rate = ", ".join(f'CASE WHEN close_change_rate > 0 THEN NULL ELSE {c}_change_rate END AS {c}_change_rate' for c in BAR_VALUES)
    f = f"""
    SELECT CASE WHEN open_change_rate > 500 THEN repeat('z', 10) || code
                WHEN open_change_rate < -90 THEN NULL ELSE code END AS code,
           CASE WHEN high_change_rate < -80 THEN NULL ELSE "date" END AS "date", {rate}
    FROM ({_features_sql(BARS)}) f, range(1, CASE WHEN close_change_rate > 0 THEN 3 ELSE 2 END) r"""
    return m, b, f


def _run_sql() -> str:
    """CTEs of the run of ``_run_inputs``: r (code, seg, mode, start)."""
    a = AS_OF_RUN
    return f"""
    known AS ({_bars_sql(f"ts < TIMESTAMP '{KNOWN_TS}'")}),
    allbars AS ({BARS}),
    r AS (
      SELECT m.code, m.market_type AS seg, max(k."date") AS latest,
             CASE WHEN max(k."date") IS NULL THEN 'initial' ELSE 'incremental' END AS mode,
             coalesce(max(k."date") + 1, DATE '{a}' - 499) AS start
      FROM ({MASTER}) m LEFT JOIN known k ON k.code = m.code GROUP BY 1, 2),
    got AS (
      SELECT r.code, b."date", (DATE '{a}' - b."date") // 100 AS i
      FROM r JOIN allbars b ON b.code = r.code
      WHERE b."date" BETWEEN r.start AND DATE '{a}'
        AND (seg = 'MACHINERY' OR (seg = 'AUTOMOBILE' AND (DATE '{a}' - b."date") // 100 <> 1)))"""


def _code_status_sql() -> str:
    """What happened to each market, told as such: no windows are built."""
    return f"""
    WITH {_run_sql()},
    n AS (SELECT code, count(*) AS n_bars FROM got GROUP BY code)
    SELECT r.code, r.mode,
           CASE WHEN seg IN ('BUILDING', 'HOUSEHOLD') THEN 'failed'
                WHEN seg = 'FURNITURE' THEN 'empty'
                WHEN seg = 'AUTOMOBILE' THEN 'partial'
                WHEN coalesce(n.n_bars, 0) = 0 THEN 'empty' ELSE 'ok' END AS status,
           CAST(CASE mode WHEN 'initial' THEN 5 ELSE 2 END AS BIGINT) AS n_windows,
           CAST(coalesce(n.n_bars, 0) AS BIGINT) AS n_bars
    FROM r LEFT JOIN n ON n.code = r.code"""


def _summary_sql() -> str:
    statuses = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in AG.STATUSES)
    return f"SELECT count(*) AS total, {statuses} FROM ({_code_status_sql()}) t"


def _plan_after_failures_sql() -> str:
    from daybars.plans.registry_incremental import gaps_sql

    a, later = AS_OF_RUN, AS_OF_LATER
    return f"""
    WITH {_run_sql()},
    """ + gaps_sql(f"""
      SELECT code, greatest(DATE '{a}' - CAST(i * 100 + 99 AS INTEGER), start) AS seg_start,
             DATE '{a}' - CAST(i * 100 AS INTEGER) AS seg_end,
             seg IN ('BUILDING', 'HOUSEHOLD') OR (seg = 'AUTOMOBILE' AND i = 1) AS failed
      FROM r, range(0, 5) w(i) WHERE DATE '{a}' - CAST(i * 100 AS INTEGER) >= start""", f"""
      SELECT r.code, coalesce(greatest(r.latest, max(g."date")) + 1, DATE '{later}' - 499) AS due
      FROM r LEFT JOIN got g ON g.code = r.code GROUP BY r.code, r.latest""")


def _accounting_sql() -> str:
    return f"""
    WITH b AS (SELECT b.code, b."date", m.market_type AS seg, (DATE '{AS_OF_MODES}' - b."date") // 100 AS i
               FROM ({BARS}) b LEFT JOIN ({MASTER}) m ON m.code = b.code)
    SELECT CASE seg WHEN 'HOUSEHOLD' THEN 'no code' WHEN 'FURNITURE' THEN 'bad json' ELSE 'bar' END AS outcome,
           CASE seg WHEN 'FURNITURE' THEN count(DISTINCT (code, i)) ELSE count(*) END AS n
    FROM (SELECT code, i, CASE WHEN seg IN ('HOUSEHOLD', 'FURNITURE') THEN seg ELSE '' END AS seg FROM b) t
    GROUP BY seg"""


def _quotes_quarantine_sql() -> str:
    a = AS_OF_MODES
    return f"""
    WITH bw AS (
      SELECT b.code, b.volume, m.market_type AS seg,
             CAST(floor((DATE '{a}' - b."date") / 100) AS INTEGER) AS i
      FROM ({BARS}) b LEFT JOIN ({MASTER}) m ON b.code = m.code)
    SELECT DISTINCT code,
           strftime(DATE '{a}' - CAST(i * 100 + 99 AS INTEGER), '%Y%m%d') AS window_start,
           strftime(DATE '{a}' - CAST(i * 100 AS INTEGER), '%Y%m%d') AS window_end,
           'rejected: segment closed' AS reason
    FROM bw WHERE seg = '{REMOVED_SEGMENT}'
    UNION ALL
    SELECT code,
           strftime(DATE '{a}' - CAST(i * 100 + 99 AS INTEGER), '%Y%m%d'),
           strftime(DATE '{a}' - CAST(i * 100 AS INTEGER), '%Y%m%d'),
           'bad date'
    FROM bw WHERE coalesce(seg, '') <> '{REMOVED_SEGMENT}' AND volume = 0"""


LINEITEM_BARS = """
    SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS "date",
           arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS "open",
           max(l_extendedprice) AS high,
           min(l_extendedprice) AS low,
           arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS "close",
           CAST(sum(l_quantity) AS BIGINT) AS volume
    FROM lineitem GROUP BY 1, 2"""


def _plan_gaps_sql() -> str:
    """Rejected windows of the incremental plan: a HOUSEHOLD code's whole
    range comes back as its original windows; an AUTOMOBILE code's second
    window comes back alone, as window 0 of its own gap."""
    return f"""
    WITH p AS ({_plan_sql(AS_OF_PLAN, "mode <> 'skip'", BASE_BARS)}),
    s AS ({MASTER})
    SELECT p.code, 'gap' AS mode, p.i, p.seg_start, p.seg_end
    FROM p JOIN s ON p.code = s.code WHERE s.market_type = '{REMOVED_SEGMENT}'
    UNION ALL
    SELECT p.code, 'gap' AS mode, 0 AS i, p.seg_start, p.seg_end
    FROM p JOIN s ON p.code = s.code WHERE s.market_type = 'AUTOMOBILE' AND p.i = 1"""


def _daily_bars_sql() -> str:
    """First load: all base bars; the daily delivery: known codes only."""
    live = f"SELECT * FROM ({BARS}) b WHERE code IN (SELECT code FROM ({MASTER}) m)"
    return _upsert_sql(BASE_BARS, live)


def _features_as_of_sql() -> str:
    """The previous bar through an as-of join on the day before."""
    rates = ", ".join(f'((n."{c}" - p."{c}") / CASE WHEN p."{c}" <> 0 THEN p."{c}" END) * 100 AS {c}_change_rate'
                      for c in BAR_VALUES)
    return f"""
    WITH n AS (SELECT *, "date" - 1 AS eve FROM ({BARS}) b WHERE "date" = DATE '{AS_OF_FEATURES}')
    SELECT n.code, n."date", {rates}
    FROM n ASOF JOIN ({BARS}) p ON p.code = n.code AND n.eve >= p."date" """


def oracle() -> dict[str, str]:
    out = _oracle()
    out["features_as_of_summary"] = out["features_as_of"]
    out["features_touched_summary"] = out["features_touched"]
    return out


def _oracle() -> dict[str, str]:
    bar_cols = 'code, "date", "open", high, low, "close", volume'
    return {
        "bars_daily": BARS,
        "master_project": MASTER,
        "master_union_markets": f"""
            SELECT CAST(c_custkey AS VARCHAR) AS code, c_name AS name,
                   CASE WHEN c_nationkey = 0 THEN '{SEGMENTS[-1]}' ELSE c_mktsegment END AS market_type
            FROM customer""",
        "master_fixed_width": MASTER,
        "quotes_parse": f"""SELECT code, "date", CASE volume WHEN 0 THEN 0.0 ELSE "open" END AS "open", high, low,
                                   "close", volume FROM ({BARS}) b""",
        "date_roundtrip": f"""SELECT code, "date", strftime("date", '%Y%m%d') AS ymd,
                                     CAST(strptime(strftime("date", '%Y%m%d'), '%Y%m%d') AS DATE) AS date_back
                              FROM ({BARS}) b""",
        "count_by_market": "SELECT c_mktsegment AS market_type, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment)",
        "latest_bar": f"""SELECT {bar_cols} FROM (
                            SELECT *, row_number() OVER (PARTITION BY code ORDER BY "date" DESC) AS rn
                            FROM ({BARS}) b) t WHERE rn = 1""",
        "lookup_by_name": f"""
            WITH m AS (SELECT * FROM ({MASTER}) m
                       WHERE lower(rtrim(name)) = lower(rtrim('{LOOKUP_NAME}'))
                       ORDER BY code LIMIT 1)
            SELECT b.code, m.name, m.market_type, b."date", b."open", b."close", b.high, b.low, b.volume,
                   row_number() OVER (PARTITION BY b.code ORDER BY b."date" DESC) AS rn
            FROM ({BARS}) b JOIN m ON b.code = m.code""",
        "dedupe_last": """
            SELECT code, "date", price, volume, seq FROM (
              SELECT CAST(user_id AS VARCHAR) AS code, CAST(ts AS DATE) AS "date", "value" AS price,
                     CAST(event_type = 'purchase' AS BIGINT) AS volume, event_id AS seq,
                     row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) AS rn
              FROM events) t WHERE rn = 1""",
        "upsert_prices": _upsert_sql(BASE_BARS, CHANGE_BARS),
        "upsert_master": f"""
            WITH b AS (SELECT CAST(c_custkey AS VARCHAR) AS code, c_name AS name, c_mktsegment AS market_type,
                              TIMESTAMP '{BASE_TS}' AS created_at, TIMESTAMP '{BASE_TS}' AS updated_at
                       FROM customer WHERE c_nationkey < 13),
                 c AS (SELECT CAST(c_custkey AS VARCHAR) AS code, upper(c_name) AS name, c_mktsegment AS market_type
                       FROM customer WHERE c_nationkey >= 10)
            SELECT coalesce(c.code, b.code) AS code,
                   CASE WHEN c.code IS NOT NULL THEN c.name ELSE b.name END AS name,
                   CASE WHEN c.code IS NOT NULL THEN c.market_type ELSE b.market_type END AS market_type,
                   CASE WHEN c.code IS NOT NULL THEN coalesce(b.created_at, TIMESTAMP '{RUN_TS}')
                        ELSE b.created_at END AS created_at,
                   CASE WHEN c.code IS NOT NULL THEN TIMESTAMP '{RUN_TS}' ELSE b.updated_at END AS updated_at
            FROM b FULL OUTER JOIN c ON b.code = c.code""",
        "upsert_features": _upsert_sql(_features_sql(BASE_BARS),
                                       f"SELECT * FROM ({_features_sql(BARS)}) f WHERE \"date\" >= DATE '2024-01-15'"),
        "plan_full": f"""
            SELECT code, 'full' AS mode, CAST(i AS INTEGER) AS i,
                   greatest(DATE '{AS_OF_MODES}' - CAST(i * 100 + 99 AS INTEGER),
                            DATE '{AS_OF_MODES}' - {BACKFILL_DAYS - 1}) AS seg_start,
                   DATE '{AS_OF_MODES}' - CAST(i * 100 AS INTEGER) AS seg_end
            FROM ({MASTER}) m CROSS JOIN range(0, {-(-BACKFILL_DAYS // 100)}) AS r(i)""",
        "plan_initial": _plan_sql(AS_OF_PLAN, "mode = 'initial'"),
        "plan_incremental": _plan_sql(AS_OF_PLAN, "mode <> 'skip'"),
        "plan_modes": f"""
            WITH lt AS (SELECT code, max("date") AS latest FROM ({BARS}) b GROUP BY code),
            r AS (
              SELECT CASE WHEN lt.latest IS NULL THEN 'initial'
                          WHEN lt.latest + 1 > DATE '{AS_OF_MODES}' THEN 'skip'
                          ELSE 'incremental' END AS mode,
                     CASE WHEN lt.latest IS NULL THEN DATE '{AS_OF_MODES}' - 499
                          ELSE lt.latest + 1 END AS start
              FROM ({MASTER}) m LEFT JOIN lt ON m.code = lt.code)
            SELECT mode, count(*) AS n_codes,
                   CAST(sum(CASE WHEN mode = 'skip' THEN 0
                                 ELSE ceil((DATE '{AS_OF_MODES}' - start + 1) / 100.0) END) AS BIGINT) AS n_windows
            FROM r GROUP BY mode""",
        "prev_bar_asof": f"""
            WITH b AS ({BARS})
            SELECT b.code, b."date" AS prev_date, b."open", b."close", b.high, b.low, b.volume
            FROM b WHERE b."date" = (SELECT max(b2."date") FROM b b2
                                     WHERE b2.code = b.code AND b2."date" < DATE '{AS_OF_FEATURES}')""",
        "features_full": _features_sql(BARS),
        "features_as_of": _features_as_of_sql(),
        "features_touched": _features_sql(_upsert_sql(BASE_BARS, CHANGE_BARS)),
        "fk_valid": f"""SELECT * FROM ({BARS}) b WHERE EXISTS (
                          SELECT 1 FROM ({MASTER}) m WHERE m.code = b.code AND m.market_type <> '{REMOVED_SEGMENT}')""",
        "fk_orphans": f"""SELECT * FROM ({BARS}) b WHERE NOT EXISTS (
                          SELECT 1 FROM ({MASTER}) m WHERE m.code = b.code AND m.market_type <> '{REMOVED_SEGMENT}')""",
        "cascade_delete": f"""SELECT * FROM ({_features_sql(BARS)}) f WHERE NOT EXISTS (
                          SELECT 1 FROM ({MASTER}) m WHERE m.code = f.code AND m.market_type = '{REMOVED_SEGMENT}')""",
        "quality_report": _quality_sql(MASTER, BARS, _features_sql(BARS)),
        "quality_faults": _quality_sql(*_faulty_sql()),
        "quotes_accounting": _accounting_sql(),
        "plan_after_failures": _plan_after_failures_sql(),
        "job_backfill": f"""SELECT b.* FROM ({BARS}) b JOIN ({MASTER}) m ON m.code = b.code
                            WHERE "date" > DATE '{AS_OF_BACKFILL}' - {BACKFILL_DAYS}""",
        "job_daily_orphans": f"""
            SELECT b.code, CASE WHEN m.market_type <> '{REMOVED_SEGMENT}' THEN 'stored' ELSE 'unknown code' END AS outcome,
                   count(*) AS n
            FROM ({BARS}) b LEFT JOIN ({MASTER}) m ON m.code = b.code GROUP BY 1, 2""",
        "job_remove_codes": f"""
            SELECT * FROM ({_features_sql(BASE_BARS)}) f WHERE code NOT IN (
              SELECT code FROM ({MASTER}) m WHERE market_type = '{REMOVED_SEGMENT}')""",
        "run_summary": _summary_sql(),
        "collected_range": f"""SELECT code, min("date") AS first_date, max("date") AS last_date,
                                      count(*) AS n_days FROM ({BARS}) b GROUP BY code""",
        "stream_catchup": BARS,
        "master_quarantine": """
            SELECT CAST(c_custkey AS VARCHAR) AS code,
                   CASE WHEN c_acctbal < 0 THEN 'short line' ELSE 'blank name' END
                     || ' (' || c_mktsegment || ')' AS reason
            FROM customer WHERE c_acctbal < 0 OR c_nationkey = 0""",
        "quotes_quarantine": _quotes_quarantine_sql(),
        "code_status_rejects": _code_status_sql(),
        "features_full_lineitem": _features_sql(LINEITEM_BARS),
        "market_counts_wide": "SELECT " + ", ".join(
            f"count(*) FILTER (WHERE c_mktsegment = '{s}') AS {s.lower()}" for s in SEGMENTS)
            + ", count(*) AS total FROM customer",
        "job_sync_master": f"""
            SELECT CAST(c_custkey AS VARCHAR) AS code, '고객 ' || substr(c_name, 10) AS name, c_mktsegment AS market_type,
                   TIMESTAMP '{RUN_TS}' AS created_at, TIMESTAMP '{RUN_TS}' AS updated_at
            FROM customer""",
        "job_daily_features": _features_sql(_daily_bars_sql()),
        "plan_gaps": _plan_gaps_sql(),
        "month_summary": f"""
            SELECT code, _bkt, "date", "open", "close", high, low, volume FROM (
              SELECT *, date_trunc('month', "date")::DATE AS _bkt,
                     row_number() OVER (PARTITION BY code, date_trunc('month', "date")
                                        ORDER BY "date" DESC) AS rn
              FROM ({LINEITEM_BARS}) b) t WHERE rn = 1""",
    }
