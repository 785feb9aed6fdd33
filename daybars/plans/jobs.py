"""User-level jobs over stored tables.

Survey rows: C1-C7 (C4 = collect then touched refresh, D10).

Each job is a few DataFrame steps; tables live under roots on shared storage
(see ``sources.tables``). Master, latest bars and name index are whole tables;
bars, features, summary and coverage are month-partitioned, so collection and
the feature refresh rewrite only the months they touch. What cannot be stored
goes to quarantine first. Bars are written before what is derived from them,
and the landing counts as read only when all is written, so a job that dies is
run again.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybars.operators.aggregates import (
    code_status, collected_range, market_counts_wide, run_summary, window_outcomes,
)
from daybars.operators.features import SUMMARY, features_as_of, features_as_of_summary, features_full
from daybars.operators.integrity import fk_orphans, fk_valid, quality_report
from daybars.operators.keyed import keep_last, upsert, upsert_with_audit
from daybars.operators.lookup import lookup_bars, lookup_indexed, name_blocks, name_index
from daybars.operators.planner import (
    latest_from_summary, plan_full, plan_incremental, plan_modes, replan_failed,
)
from daybars.schemas import BARS, COVERAGE, FEATURES, LENGTH_LIMITS, MARKETS, MASTER, NAME_BLOCKS, NAMES, QUOTE
from daybars.session import checkpoint_dir
from daybars.sources.master_text import (
    TAIL_WIDTH, read_master_zip, read_masters, split_master_lines, union_markets,
)
from daybars.sources.quotes import (
    answers_of, bars_of, parse_responses, quarantine_of, quote_stream, ranked, read_quotes, stage,
)
from daybars.sources.tables import (
    changed_months, checks_of, delete_keys, materialised, merge_latest, merge_months, read_months,
    read_summary, read_table, refresh_feature_months, stored_months, write_months, write_summary, write_table,
)

_BAR_COLS = [f.name for f in BARS.fields]


def quarantine(bad: DataFrame, root: str | None, run_id: str | None) -> None:
    """Quarantine rows of one run under ``run=<id>``; a retried run with the
    same id overwrites its own folder instead of adding duplicates."""
    if root is not None:
        rid = run_id or uuid.uuid4().hex
        bad.write.mode("overwrite").parquet(f"{root.rstrip('/')}/run={rid}")


def job_sync_master(spark: SparkSession, sources: dict, master_root: str, run_ts,
                    tail=TAIL_WIDTH, zipped: bool = False,
                    quarantine_root: str | None = None, run_id: str | None = None,
                    members: dict | None = None, names_root: str | None = None) -> DataFrame:
    """Parse every market's master file, resolve codes listed in several
    markets (last market in ``sources`` order wins), upsert into the master
    table. ``members`` names the entry of each market's zip archive; an
    archive without it is an error. Returns the per-market counts and their
    total (one row)."""
    checkpoint_dir(spark)
    if zipped:
        parts, bads = [], []
        for m, path in sources.items():
            t = tail[m] if isinstance(tail, dict) else tail
            r, q = split_master_lines(read_master_zip(spark, path, (members or {}).get(m)), m, t)
            parts.append(r)
            bads.append(q)
        rows, bad = union_markets(parts), reduce(DataFrame.unionByName, bads)
    else:
        rows, bad = read_masters(spark, sources, tail)
    rows = materialised(rows, "master")       # parsed once; reused below
    changes = keep_last(rows, ["code"], "_prio").drop("_prio")
    quarantine(bad, quarantine_root, run_id)
    merged = upsert_with_audit(read_table(spark, master_root, MASTER), changes, ["code"], run_ts)
    write_table(merged, master_root, sort_by=["code"])
    if names_root is not None:
        job_index_names(spark, master_root, names_root)
    return market_counts_wide(rows, markets=tuple(sources))


def job_index_names(spark: SparkSession, master_root: str, names_root: str) -> None:
    """The name index of the master (see ``operators.lookup.name_index``): rows
    under ``names_root``, ranges of names beside it."""
    write_table(name_index(read_table(spark, master_root, MASTER)), names_root, sort_by=["name_key"])
    write_table(name_blocks(read_table(spark, names_root, NAMES)), _blocks(names_root), sort_by=["name_key"])


def _blocks(names_root: str) -> str:
    return f"{names_root.rstrip('/')}_blocks"


def as_of_date(as_of) -> dt.date:
    return dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of


def _latest(spark, bars_root, summary_root, latest_root=None):
    """(code, latest) from the smallest table that knows it, or None."""
    if latest_root is not None:
        return read_table(spark, latest_root, BARS).select("code", F.col("date").alias("latest"))
    if summary_root is not None:
        return latest_from_summary(read_summary(spark, bars_root, summary_root, BARS))


def job_plan(spark: SparkSession, master_root: str, bars_root: str, as_of,
             days: int | None = None, summary_root: str | None = None,
             coverage_root: str | None = None, latest_root: str | None = None,
             record: bool = False) -> DataFrame:
    """C2/C3 planning: the windows to fetch (incremental, or a ``days``
    backfill when given). The latest date per code comes from the table of
    latest bars (``latest_root``: one row a code), else from the month summary,
    else from a scan of all bars. With ``coverage_root`` every day that was
    asked for before and not answered since is planned again, also where
    newer bars have moved past it.

    ``record`` notes the planned windows in the coverage as asked for and not
    answered. The answers, collected or streamed, say otherwise later; windows
    that never get one are planned again."""
    master = read_table(spark, master_root, MASTER)
    if days is not None:
        plan = plan_full(master, as_of, days)
    else:
        plan = plan_incremental(master, read_months(spark, bars_root, BARS), as_of,
                                _latest(spark, bars_root, summary_root, latest_root))
        if coverage_root is not None:
            plan = replan_failed(plan, read_months(spark, coverage_root, COVERAGE), master)
    if record and coverage_root is not None:
        plan = materialised(plan, "plan")
        keys = ["code", "seg_start", "seg_end"]
        asked = plan.select(*keys, F.lit(False).alias("answered"), F.lit(0).cast("bigint").alias("n_bars"))
        known = read_months(spark, coverage_root, COVERAGE, changed_months(plan, "seg_end"))
        merge_coverage(spark, coverage_root, asked.join(known, keys, "left_anti"))
    return plan


def merge_coverage(spark: SparkSession, coverage_root: str, outcomes: DataFrame) -> None:
    """Keep the outcome of windows (code, seg_start, seg_end, answered, n_bars)."""
    merge_months(spark, coverage_root, materialised(outcomes, "coverage"), ["code", "seg_start", "seg_end"], COVERAGE,
                 date_col="seg_end", sort_by=["code", "seg_end"])


def answered_windows(answers: DataFrame) -> DataFrame:
    """Coverage rows of the answers themselves, for codes and windows that are
    known; for answers that come without their plan, as in a stream."""
    return (answers.where("code IS NOT NULL AND seg_start <= seg_end")
                   .select("code", "seg_start", "seg_end", (~F.col("rejected")).alias("answered"), "n_bars"))


def job_collect(spark: SparkSession, landing: str, bars_root: str,
                modes: DataFrame | None = None, quarantine_root: str | None = None,
                run_id: str | None = None, summary_root: str | None = None,
                multiline: bool = False, plan: DataFrame | None = None,
                master_root: str | None = None, coverage_root: str | None = None,
                latest_root: str | None = None, checks_root: str | None = None,
                landing_checkpoint: str | None = None):
    """Parse landed responses once, de-duplicate by arrival, upsert
    into the bars table. Returns ``(changes, summary)``: ``changes`` is the
    stored change set (input of the feature refresh), ``summary`` the run
    summary when ``modes`` and ``plan`` are given. With ``master_root`` bars of
    unknown codes go to quarantine. With ``coverage_root`` the outcome of
    every planned window is kept for the next plan.

    With ``landing_checkpoint`` a file is read once in its life: the file
    source's own log in that folder knows what was processed, and a run that dies is
    given the same files again. Without it the whole folder is read."""
    checkpoint_dir(spark)
    # The plan is read before anything is committed: it describes what was
    # to be fetched for the tables as they are now.
    if plan is not None:
        plan = materialised(plan, "plan")
    done: list[tuple[DataFrame, DataFrame]] = []

    def collect(raw: DataFrame, batch: str = "") -> None:
        parsed = ranked(stage(parse_responses(raw), spark))
        answers = materialised(answers_of(parsed), "answers")
        rid = f"{run_id}{batch}" if run_id else None
        done.append((store(spark, parsed, bars_root, quarantine_root, rid, summary_root, master_root, latest_root,
                           checks_root), answers))
        if coverage_root is not None and plan is not None:
            merge_coverage(spark, coverage_root, window_outcomes(plan, _last_answers(done)))

    if landing_checkpoint is None:
        collect(read_quotes(spark, landing, multiline))
    else:
        run = (quote_stream(spark, landing, multiline=multiline).writeStream
               .foreachBatch(lambda raw, epoch: collect(raw, f"-{epoch}"))
               .option("checkpointLocation", landing_checkpoint).trigger(availableNow=True).start())
        run.awaitTermination()
        if run.exception() is not None:
            raise RuntimeError(str(run.exception()))
        if not done:                                # nothing new has landed
            none = parse_responses(spark.createDataFrame([], QUOTE))
            done.append((bars_of(none).select(*_BAR_COLS), answers_of(none)))
            if coverage_root is not None and plan is not None:
                merge_coverage(spark, coverage_root, window_outcomes(plan, done[0][1]))
    summary = None
    if modes is not None and plan is not None:
        summary = run_summary(code_status(modes, plan, _last_answers(done)))
    return _last([changes for changes, _ in done], ["code", "date"]), summary


def _last(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row per key of frames in order of time."""
    if len(parts) == 1:
        return parts[0]
    rows = reduce(DataFrame.unionByName, [p.withColumn("_batch", F.lit(k)) for k, p in enumerate(parts)])
    return keep_last(rows, keys, "_batch").drop("_batch")


def _last_answers(done: list) -> DataFrame:
    return _last([answers for _, answers in done], ["code", "seg_start", "seg_end"])


def store(spark: SparkSession, parsed: DataFrame, bars_root: str, quarantine_root: str | None = None,
          run_id: str | None = None, summary_root: str | None = None, master_root: str | None = None,
          latest_root: str | None = None, checks_root: str | None = None) -> DataFrame:
    """Ranked elements into quarantine, bars, summary and latest bars, in this
    order; returns the stored change set. Its constraints are counted as it is
    written; a broken one raises before the bars change."""
    changes = keep_last(bars_of(parsed), ["code", "date"], "seq").select(*_BAR_COLS)
    bad = quarantine_of(parsed)
    if master_root is not None:
        master = read_table(spark, master_root, MASTER)
        changes = materialised(changes, "changes")
        text = F.lit(None).cast("string")
        bad = bad.unionByName(fk_orphans(changes, master).select(
            F.lit("bars").alias("source"), "code", text.alias("window_start"), text.alias("window_end"),
            F.lit("unknown code").alias("reason"), F.to_json(F.struct(*_BAR_COLS)).alias("raw")))
        changes = fk_valid(changes, master)
    quarantine(bad, quarantine_root, run_id)
    changes = materialised(changes, "bars", checks_of(BARS, LENGTH_LIMITS), checks_root, run_id)
    months = changed_months(changes)
    if months:
        merge_months(spark, bars_root, changes, ["code", "date"], BARS, sort_by=["code", "date"], months=months)
        if summary_root is not None:
            write_summary(spark, bars_root, summary_root, months, BARS)
        if latest_root is not None:
            merge_latest(spark, latest_root, changes, BARS)
    return changes


def job_features_full(spark: SparkSession, bars_root: str, features_root: str,
                      keep_unmatched: bool = False) -> None:
    """Rebuild every feature row from the full history: one scan and one
    shuffle for the window, one that packs months into files.

    The months written are those of the bars and those of the features, so a
    month whose bars are gone loses its features. ``keep_unmatched`` keeps
    old rows the rebuild does not produce (a strict upsert, for tables edited
    outside these jobs) at the cost of a full anti-join."""
    months = {*stored_months(spark, bars_root), *stored_months(spark, features_root)}
    fresh = features_full(read_months(spark, bars_root, BARS))
    if keep_unmatched:
        fresh = upsert(read_months(spark, features_root, FEATURES), fresh, ["code", "date"])
    write_months(fresh, features_root, months, sort_by=["code", "date"], cluster=False)


def job_daily(spark: SparkSession, as_of, master_root: str, bars_root: str,
              features_root: str, landing: str, quarantine_root: str | None = None,
              as_of_only: bool = False, run_id: str | None = None,
              summary_root: str | None = None, multiline: bool = False,
              coverage_root: str | None = None, latest_root: str | None = None,
              checks_root: str | None = None, landing_checkpoint: str | None = None) -> DataFrame | None:
    """C4: collect what has landed, then refresh features.

    Default: refresh the touched months (each changed bar, its successors
    and the months they seed), which covers multi-day catch-ups.
    ``as_of_only=True`` reproduces the single-date refresh (features for bars
    dated ``as_of`` only).

    With ``summary_root`` the month summary is maintained and used, so the
    planner and the refresh read one row per (code, month) instead of the
    whole bar history. With ``coverage_root`` failed windows are planned
    again next time."""
    checkpoint_dir(spark)
    master = read_table(spark, master_root, MASTER)
    latest = _latest(spark, bars_root, summary_root, latest_root)
    modes = materialised(plan_modes(master, read_months(spark, bars_root, BARS), as_of, latest), "modes")
    plan = job_plan(spark, master_root, bars_root, as_of, summary_root=summary_root, coverage_root=coverage_root,
                    latest_root=latest_root)
    changes, summary = job_collect(spark, landing, bars_root, modes, quarantine_root, run_id,
                                   summary_root, multiline, plan, master_root, coverage_root, latest_root, checks_root,
                                   landing_checkpoint)
    if as_of_only:
        if summary_root is not None:
            fresh = features_as_of_summary(read_summary(spark, bars_root, summary_root, BARS),
                                           read_months(spark, bars_root, BARS, [as_of_date(as_of)]),
                                           as_of)
        else:
            fresh = features_as_of(read_months(spark, bars_root, BARS), as_of)
        merge_months(spark, features_root, materialised(fresh, "features"), ["code", "date"], FEATURES,
                     sort_by=["code", "date"])
    else:
        msum = None if summary_root is None else read_summary(spark, bars_root, summary_root, BARS)
        refresh_feature_months(spark, features_root, read_months(spark, bars_root, BARS), changes, FEATURES,
                               bars_root=bars_root, bars_schema=BARS, summary=msum)
    return summary


def job_remove_codes(spark: SparkSession, codes: DataFrame, master_root: str, bars_root: str, features_root: str,
                     summary_root: str | None = None, coverage_root: str | None = None,
                     latest_root: str | None = None, names_root: str | None = None) -> None:
    """Codes leave the master, and with them their bars, features, summary,
    coverage and latest bar (ON DELETE CASCADE). Children go first, so a run
    that dies leaves no orphan and can be repeated. With ``summary_root`` the
    months to rewrite are read from the summary (one row per code and month), not
    from the bars; the summary itself goes after them."""
    checkpoint_dir(spark)
    removed = materialised(codes.select("code").distinct(), "removed")
    where = None
    if summary_root is not None:
        where = read_summary(spark, bars_root, summary_root, BARS).select("code", F.col("_bkt").alias("date"))
    if coverage_root is not None:
        delete_keys(spark, coverage_root, COVERAGE, removed, date_col="seg_end", sort_by=["code", "seg_end"])
    delete_keys(spark, features_root, FEATURES, removed, sort_by=["code", "date"], where=where)
    delete_keys(spark, bars_root, BARS, removed, sort_by=["code", "date"], where=where)
    if summary_root is not None:
        delete_keys(spark, summary_root, SUMMARY, removed, date_col="_bkt", sort_by=["code"])
    for root, schema in ((latest_root, BARS), (names_root, NAMES), (master_root, MASTER)):
        if root is not None:
            left = read_table(spark, root, schema).join(removed, "code", "left_anti")
            write_table(left.select(*schema.fieldNames()), root, sort_by=["name_key"] if schema is NAMES else ["code"])


def job_quality(spark: SparkSession, master_root: str, bars_root: str, features_root: str, markets=MARKETS) -> DataFrame:
    """Q1-Q6 over the stored tables: rows (tbl, check_name, n_bad)."""
    return quality_report(read_table(spark, master_root, MASTER), read_months(spark, bars_root, BARS),
                          read_months(spark, features_root, FEATURES), markets)


def job_checks(spark: SparkSession, checks_root: str) -> DataFrame:
    """Q1-Q5 as counted by the writes: rows written and rows that broke a check,
    by table and check. Reads the counts, not the tables."""
    return (spark.read.parquet(checks_root).groupBy("tbl", "check_name")
                 .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bad").alias("n_bad")))


def job_collected(spark: SparkSession, bars_root: str) -> DataFrame:
    """First date, last date and number of bars of every code."""
    return collected_range(read_months(spark, bars_root, BARS))


def job_search(spark: SparkSession, master_root: str, bars_root: str, name: str,
               case_sensitive: bool = False, names_root: str | None = None) -> DataFrame:
    """Name -> code -> bars, newest first. With ``names_root`` the code
    comes from the name index instead of a scan of the master."""
    if names_root is not None:
        return lookup_indexed(read_table(spark, names_root, NAMES), read_table(spark, _blocks(names_root), NAME_BLOCKS),
                              read_months(spark, bars_root, BARS), name, case_sensitive)
    return lookup_bars(read_table(spark, master_root, MASTER),
                       read_months(spark, bars_root, BARS), name, case_sensitive)


def job_master_counts(spark: SparkSession, master_root: str, markets=MARKETS) -> DataFrame:
    """Rows per market and total, one row."""
    return market_counts_wide(read_table(spark, master_root, MASTER), markets)
