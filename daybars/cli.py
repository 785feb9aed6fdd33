"""Command line for the jobs, for ``spark-submit`` (or ``python -m daybars.cli``).

Tables live under one root on shared storage: ``<root>/master``,
``<root>/bars``, ``<root>/features``, ``<root>/summary``, ``<root>/coverage``,
``<root>/latest``, ``<root>/names``, ``<root>/checks``, ``<root>/quarantine``; what
was read of a landing is known under ``<root>/landings``. ``plan``, ``search`` and ``collected`` write their
whole result as JSON lines to ``--out``, from the executors, and print the
number of rows; the other commands print a result of a few rows.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
import zlib


def _tables(root: str) -> dict:
    r = root.rstrip("/")
    return {k: f"{r}/{k}" for k in ("master", "bars", "features", "summary", "coverage", "latest", "names", "checks", "landings",
                                   "quarantine")}


def _landing(t: dict, landing: str) -> str:
    """Where the file source keeps what it has read of this landing."""
    return f"{t['landings']}/{zlib.crc32(landing.rstrip('/').encode()):08x}"


def _print(df) -> None:
    """Results of one row per market, check or run."""
    for row in df.collect():
        print(json.dumps(row.asDict(), default=str, ensure_ascii=False))


def _write(df, out: str) -> None:
    df.write.mode("errorifexists").json(out)
    print(json.dumps({"out": out, "rows": df.sparkSession.read.schema(df.schema).json(out).count()}))


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="daybars")
    p.add_argument("--root", required=True, help="folder holding the tables (shared storage)")
    sub = p.add_subparsers(dest="cmd", required=True)

    s = sub.add_parser("sync-master", help="parse market master files and upsert")
    s.add_argument("--market", action="append", required=True, metavar="NAME=PATH",
                   help="market and file (repeat; later markets win for shared codes)")
    s.add_argument("--zipped", action="store_true")
    s.add_argument("--member", action="append", default=[], metavar="NAME=ENTRY",
                   help="entry of the market's zip archive")
    s.add_argument("--run-ts", default=None, help="timestamp of this run (default: now, UTC)")
    s.add_argument("--run-id", default=None, help="name of the run in the quarantine")

    s = sub.add_parser("plan", help="windows still to fetch")
    s.add_argument("--as-of", required=True)
    s.add_argument("--days", type=int, default=None, help="full backfill of N days instead")
    s.add_argument("--out", required=True, help="folder for the windows (JSON lines)")
    s.add_argument("--record", action="store_true", help="keep the windows in the coverage as not answered yet")

    s = sub.add_parser("daily", help="collect landed quotes and refresh features")
    s.add_argument("--as-of", required=True)
    s.add_argument("--landing", required=True)
    s.add_argument("--as-of-only", action="store_true", help="refresh only bars dated as-of")
    s.add_argument("--run-id", default=None)
    s.add_argument("--whole-landing", action="store_true", help="read files again that earlier runs have read")

    sub.add_parser("rebuild-features", help="recompute every feature row")

    s = sub.add_parser("search", help="bars of a code, by name, newest first")
    s.add_argument("--name", required=True)
    s.add_argument("--case-sensitive", action="store_true")
    s.add_argument("--out", required=True, help="folder for the bars (JSON lines)")

    s = sub.add_parser("collected", help="first and last date and number of bars per code")
    s.add_argument("--out", required=True)

    sub.add_parser("counts", help="master rows per market and total")
    s = sub.add_parser("quality", help="integrity checks of the stored tables")
    s.add_argument("--markets", nargs="+", default=None)

    s = sub.add_parser("remove", help="remove codes with their bars and features")
    s.add_argument("--codes", required=True, help="text file or folder, one code per line")

    s = sub.add_parser("catchup", help="streaming catch-up of landed quote files")
    s.add_argument("--landing", required=True)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--every", default=None, help="keep running on this schedule")

    sub.add_parser("checks", help="constraint counts of all writes so far")
    return p


def main(argv=None, spark=None) -> int:
    from pyspark.sql import functions as F

    from daybars.functions.parse import utrim
    from daybars.plans import jobs
    from daybars.schemas import MARKETS
    from daybars.session import get_session
    from daybars.streaming.catchup import start_catchup

    a = build_parser().parse_args(argv)
    spark = spark or get_session()
    t = _tables(a.root)
    if a.cmd == "sync-master":
        sources = dict(x.split("=", 1) for x in a.market)
        members = dict(x.split("=", 1) for x in a.member)
        run_ts = (dt.datetime.fromisoformat(a.run_ts) if a.run_ts
                  else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
        _print(jobs.job_sync_master(spark, sources, t["master"], run_ts, zipped=a.zipped,
                                    quarantine_root=t["quarantine"], run_id=a.run_id, members=members,
                                    names_root=t["names"]))
    elif a.cmd == "plan":
        _write(jobs.job_plan(spark, t["master"], t["bars"], a.as_of, a.days,
                             coverage_root=t["coverage"], latest_root=t["latest"], record=a.record), a.out)
    elif a.cmd == "daily":
        _print(jobs.job_daily(spark, a.as_of, t["master"], t["bars"], t["features"], a.landing,
                              quarantine_root=t["quarantine"], as_of_only=a.as_of_only,
                              run_id=a.run_id, summary_root=t["summary"], coverage_root=t["coverage"],
                              latest_root=t["latest"], checks_root=t["checks"],
                              landing_checkpoint=None if a.whole_landing else _landing(t, a.landing)))
    elif a.cmd == "rebuild-features":
        jobs.job_features_full(spark, t["bars"], t["features"])
        print(json.dumps({"rebuilt": True}))
    elif a.cmd == "search":
        _write(jobs.job_search(spark, t["master"], t["bars"], a.name, a.case_sensitive, t["names"]), a.out)
    elif a.cmd == "collected":
        _write(jobs.job_collected(spark, t["bars"]), a.out)
    elif a.cmd == "counts":
        _print(jobs.job_master_counts(spark, t["master"]))
    elif a.cmd == "quality":
        _print(jobs.job_quality(spark, t["master"], t["bars"], t["features"], a.markets or MARKETS))
    elif a.cmd == "remove":
        codes = spark.read.text(a.codes).select(utrim(F.col("value")).alias("code")).where("code <> ''")
        jobs.job_remove_codes(spark, codes, t["master"], t["bars"], t["features"], t["summary"], t["coverage"],
                              t["latest"], t["names"])
        print(json.dumps({"removed": True}))
    elif a.cmd == "catchup":
        q = start_catchup(spark, a.landing, t["bars"], a.checkpoint, features_root=t["features"],
                          quarantine_root=t["quarantine"], summary_root=t["summary"], every=a.every,
                          master_root=t["master"], coverage_root=t["coverage"], latest_root=t["latest"],
                          checks_root=t["checks"])
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    elif a.cmd == "checks":
        _print(jobs.job_checks(spark, t["checks"]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
