"""Registered queries of what the library keeps between runs: coverage,
planner state, probe dates, search index, checks at write, bucketed history.

Same contract as ``plans.registry``: whole driver tables, fixed parameters, a
DuckDB oracle for each.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybars import adapters as A
from daybars.operators import features as FE
from daybars.operators import planner as PL
from daybars.plans import registry as R

# Fixed parameters: three runs on successive days, and which markets each leaves unanswered.
RUNS = ("2024-04-25", "2024-04-26", "2024-04-27")
FAILED_IN = {"AUTOMOBILE": (0, 1), "BUILDING": (0, 1, 2), "FURNITURE": (1,), "HOUSEHOLD": (0, 2), "MACHINERY": ()}


# ------------------------------------------------------------------ coverage
def q_plan_after_three_failures(spark, d):
    """Three daily runs over the same missing days, whose windows end a
    day later each time and overlap. What failed in every run that asked for it
    is planned once, what any run answered is not planned again."""
    master, known = R._master(spark, d), R._known(spark, d)
    seg = R._segments(master)
    asked = []
    for k, as_of in enumerate(RUNS):
        failed = [s for s, runs in FAILED_IN.items() if k in runs]
        asked.append(PL.plan_incremental(master, known, as_of).join(seg, "code").select(
            "code", "seg_start", "seg_end", (~F.col("_seg").isin(*failed)).alias("answered")))
    coverage = reduce(DataFrame.unionByName, asked)
    plan = PL.plan_incremental(master, R._bars(spark, d), R.AS_OF_LATER)
    return PL.replan_failed(plan, coverage, master).where(F.col("mode") == "gap")


def gaps_sql(asked: str, due: str) -> str:
    """Day by day: days of failed rows of ``asked`` (code, seg_start, seg_end,
    failed) that no answered row holds and that lie before the code's ``due``
    (code, due) or after AS_OF_LATER, as windows counted back from each gap's end."""
    return f"""
    asked AS ({asked}), due AS ({due}),
    days AS (SELECT code, failed, CAST(unnest(generate_series(seg_start, seg_end, INTERVAL 1 DAY)) AS DATE) AS d FROM asked),
    open_days AS (
      SELECT code, d FROM days LEFT JOIN due USING (code)
      WHERE d < due.due OR d > DATE '{R.AS_OF_LATER}' OR due.due IS NULL
      GROUP BY code, d HAVING bool_and(failed)),
    grouped AS (SELECT code, d, d - CAST(row_number() OVER (PARTITION BY code ORDER BY d) AS INTEGER) AS g FROM open_days),
    gaps AS (SELECT code, min(d) AS s, max(d) AS e FROM grouped GROUP BY code, g)
    SELECT code, 'gap' AS mode, CAST(i AS INTEGER) AS i, greatest(e - CAST(i * 100 + 99 AS INTEGER), s) AS seg_start,
           e - CAST(i * 100 AS INTEGER) AS seg_end
    FROM gaps, range(0, 30) w(i) WHERE e - CAST(i * 100 AS INTEGER) >= s"""


def _three_failures_sql() -> str:
    def run(k, as_of):
        failed = ", ".join(f"'{s}'" for s, runs in FAILED_IN.items() if k in runs)
        return f"""
          SELECT code, greatest(DATE '{as_of}' - CAST(i * 100 + 99 AS INTEGER), start) AS seg_start,
                 DATE '{as_of}' - CAST(i * 100 AS INTEGER) AS seg_end, seg IN ({failed}) AS failed
          FROM (SELECT code, seg, coalesce(latest + 1, DATE '{as_of}' - 499) AS start FROM m) t, range(0, 10) w(i)
          WHERE DATE '{as_of}' - CAST(i * 100 AS INTEGER) >= start"""
    return f"""
    WITH known AS ({R._bars_sql(f"ts < TIMESTAMP '{R.KNOWN_TS}'")}),
    m AS (SELECT m.code, m.market_type AS seg, max(k."date") AS latest
          FROM ({R.MASTER}) m LEFT JOIN known k ON k.code = m.code GROUP BY 1, 2),
    """ + gaps_sql("\n UNION ALL ".join(run(k, a) for k, a in enumerate(RUNS)), f"""
      SELECT m.code, coalesce(max(b."date") + 1, DATE '{R.AS_OF_LATER}' - 499) AS due
      FROM m LEFT JOIN ({R.BARS}) b ON b.code = m.code GROUP BY 1""")


# -------------------------------------------------------------- probe dates
def _probes(spark, d):
    """Every user's last day of each kind of event, and the day they signed up
    for nothing at all: users with bars, users without, repeated days."""
    ev = R._events(spark, d)
    last = ev.groupBy(F.col("user_id").cast("string").alias("code"), F.col("event_type").alias("kind")).agg(
        F.to_date(F.max("ts")).alias("date"))
    known = R._master(spark, d).select("code", F.lit("fixed").alias("kind"), F.lit(_dt.date(2024, 1, 15)).alias("date"))
    return last.unionByName(known)


def q_asof_probes(spark, d):
    """Every code at dates of its own, against its latest bar before each."""
    return FE.bars_before(_probes(spark, d), R._bars(spark, d))


def _asof_probes_sql() -> str:
    return f"""
    WITH p AS (
      SELECT CAST(user_id AS VARCHAR) AS code, event_type AS kind, CAST(max(ts) AS DATE) AS "date" FROM events GROUP BY 1, 2
      UNION ALL SELECT code, 'fixed', DATE '2024-01-15' FROM ({R.MASTER}) m)
    SELECT p.code, p."date", p.kind, b."date" AS prev_date, b."open" AS prev_open, b."close" AS prev_close,
           b.high AS prev_high, b.low AS prev_low, b.volume AS prev_volume
    FROM p ASOF LEFT JOIN ({R.BARS}) b ON b.code = p.code AND b."date" < p."date" """


# ------------------------------------------------------------ planner state
def q_plan_latest_table(spark, d):
    """Two deliveries are collected and every code's latest bar is kept
    beside them; the plan of a later day reads that table, not the bars."""
    from daybars.plans.jobs import job_collect, job_plan

    t = R._stored(spark, d, "latest")
    latest = f"{t['bars']}-latest"
    A.quote_json_lines(A.quote_records(R._base_bars(spark, d), R.AS_OF_MODES, 1)).write.text(t["landing1"])
    job_collect(spark, t["landing1"], t["bars"], latest_root=latest)
    A.quote_json_lines(A.quote_records(R._change_bars(spark, d), R.AS_OF_MODES, 2)).write.text(t["landing2"])
    job_collect(spark, t["landing2"], t["bars"], latest_root=latest)
    return job_plan(spark, t["master"], t["bars"], R.AS_OF_PLAN, latest_root=latest)


def q_stream_coverage(spark, d):
    """ST1/G5: the windows of a run are recorded when they are planned, their
    answers come as a stream; what was rejected or never answered is planned
    again on a later day."""
    from daybars.plans.jobs import job_collect, job_plan
    from daybars.streaming.catchup import start_catchup

    t = R._stored(spark, d, "stream-coverage")
    A.quote_json_lines(A.quote_records(R._known(spark, d), R.AS_OF_MODES, 1)).write.text(t["landing1"])
    job_collect(spark, t["landing1"], t["bars"])
    job_plan(spark, t["master"], t["bars"], R.AS_OF_RUN, coverage_root=t["coverage"], record=True)
    _, _, responses = R._run_inputs(spark, d, R.AS_OF_RUN)
    for seq in (1, 2):          # retries land after what they repeat
        A.quote_json_lines(responses.where(F.col("fetch_seq") == seq)).write.text(f"{t['landing2']}/{seq}")
    run = start_catchup(spark, f"{t['landing2']}/*", t["bars"], f"{t['landing2']}-read", coverage_root=t["coverage"])
    run.awaitTermination()
    if run.exception() is not None:
        raise RuntimeError(str(run.exception()))
    return job_plan(spark, t["master"], t["bars"], R.AS_OF_LATER, coverage_root=t["coverage"]).where(F.col("mode") == "gap")


def q_landing_read_once(spark, d):
    """Two deliveries into one folder, collected by two runs that share the
    record of what was read; the second run reads only the second delivery."""
    from daybars.plans.jobs import job_collect
    from daybars.schemas import BARS
    from daybars.sources.tables import read_months

    t = R._stored(spark, d, "read-once")
    for k, bars in ((1, R._base_bars(spark, d)), (2, R._change_bars(spark, d))):
        A.quote_json_lines(A.quote_records(bars, R.AS_OF_MODES, k)).write.text(f"{t['landing1']}/{k}")
        job_collect(spark, f"{t['landing1']}/*", t["bars"], landing_checkpoint=f"{t['landing1']}-read")
    return read_months(spark, t["bars"], BARS)


# ---------------------------------------------------- search, checks, buckets
def q_lookup_indexed(spark, d):
    """The stored tables searched by way of the name index."""
    from daybars.plans.jobs import job_index_names, job_search
    from daybars.sources.tables import changed_months, write_months

    t = R._stored(spark, d, "search")
    names = f"{t['master']}-names"
    job_index_names(spark, t["master"], names)
    bars = R._bars(spark, d)
    write_months(bars, t["bars"], changed_months(bars), sort_by=["code", "date"])
    return job_search(spark, t["master"], t["bars"], R.LOOKUP_NAME, names_root=names)


def q_checks_at_write(spark, d):
    """Q3/Q4: two deliveries; in the second the codes of one day are too long for
    the table, so its commit is refused. Returns what the writes counted, and how
    many bars are stored."""
    from daybars.plans.jobs import job_checks, job_collect
    from daybars.schemas import BARS
    from daybars.sources.tables import BrokenConstraint, read_months

    t = R._stored(spark, d, "checks")
    checks = f"{t['bars']}-checks"
    A.quote_json_lines(A.quote_records(R._base_bars(spark, d), R.AS_OF_MODES, 1)).write.text(t["landing1"])
    job_collect(spark, t["landing1"], t["bars"], checks_root=checks)
    long_code = F.when(F.col("date") == F.lit(_dt.date(2024, 1, 20)), F.concat(F.lit("x" * 10), "code")).otherwise(F.col("code"))
    A.quote_json_lines(A.quote_records(R._change_bars(spark, d).withColumn("code", long_code), R.AS_OF_MODES, 2)).write.text(t["landing2"])
    try:
        job_collect(spark, t["landing2"], t["bars"], checks_root=checks)
    except BrokenConstraint:
        pass
    stored = read_months(spark, t["bars"], BARS).agg(F.count(F.lit(1)).alias("n_rows"))
    return job_checks(spark, checks).unionByName(
        stored.select(F.lit("bars").alias("tbl"), F.lit("stored").alias("check_name"), "n_rows", F.lit(0).cast("bigint").alias("n_bad")))


def q_features_full_bucketed(spark, d):
    """The history bucketed by code through the catalog; the features
    are computed from it without an exchange."""
    import uuid

    from daybars.session import scratch_dir
    from daybars.sources.bucketed import open_bucketed, store_bucketed

    table = f"bars_{uuid.uuid4().hex[:12]}"
    open_bucketed(spark, table, scratch_dir(spark, "bucketed"), 16)
    store_bucketed(A.bars_from_lineitem(A.load(spark, d, "lineitem")), table, 16)
    return FE.features_full(spark.table(table))


def _checks_sql() -> str:
    names = ["null_code", "null_date", "null_open", "null_high", "null_low", "null_close", "null_volume", "len_code"]
    late = f"""(SELECT count(*) FILTER (WHERE "date" = DATE '2024-01-20') FROM ({R.CHANGE_BARS}) c)"""
    rows = " UNION ALL ".join(
        f"SELECT 'bars' AS tbl, '{n}' AS check_name, CAST(n AS BIGINT) AS n_rows, "
        f"CAST({late if n == 'len_code' else 0} AS BIGINT) AS n_bad FROM written" for n in names)
    return f"""
    WITH base AS (SELECT count(*) AS n FROM ({R.BASE_BARS}) b), ch AS (SELECT count(*) AS n FROM ({R.CHANGE_BARS}) c),
    written AS (SELECT base.n + ch.n AS n FROM base, ch)
    {rows} UNION ALL SELECT 'bars', 'stored', CAST(n AS BIGINT), CAST(0 AS BIGINT) FROM base"""


QUERIES = {
    "plan_after_three_failures": q_plan_after_three_failures,
    "asof_probes": q_asof_probes,
    "plan_latest_table": q_plan_latest_table,
    "stream_coverage": q_stream_coverage,
    "landing_read_once": q_landing_read_once,
    "lookup_indexed": q_lookup_indexed,
    "checks_at_write": q_checks_at_write,
    "features_full_bucketed": q_features_full_bucketed,
}


def oracle() -> dict[str, str]:
    known = R.oracle()
    return {
        "plan_after_three_failures": _three_failures_sql(),
        "asof_probes": _asof_probes_sql(),
        "plan_latest_table": R._plan_sql(R.AS_OF_PLAN, "mode <> 'skip'",
                                         R._upsert_sql(R.BASE_BARS, R.CHANGE_BARS)),
        "stream_coverage": known["plan_after_failures"],
        "landing_read_once": R._upsert_sql(R.BASE_BARS, R.CHANGE_BARS),
        "lookup_indexed": known["lookup_by_name"],
        "checks_at_write": _checks_sql(),
        "features_full_bucketed": known["features_full_lineitem"],
    }
