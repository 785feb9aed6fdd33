"""Per-code and per-market aggregates. All are partial (map-side) aggregates
over column-pruned scans; output is one row per group.

Survey rows: A1 A3 A5 A6 A7 O3 C7 (D18).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybars.schemas import BAR_VALUES


def latest_bar(bars: DataFrame) -> DataFrame:
    """Newest bar of every code (top-1 by date, no sort). Per-column
    ``max_by`` on the unique ``(code, date)`` stays a hash aggregate."""
    return (bars.groupBy("code")
                .agg(F.max("date").alias("date"),
                     *[F.max_by(c, "date").alias(c) for c in BAR_VALUES]))


def collected_range(bars: DataFrame) -> DataFrame:
    """First date, last date and number of bars per code."""
    return bars.groupBy("code").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("n_days"))


def count_by_market(master: DataFrame) -> DataFrame:
    """Rows per market plus a grand-total row (``market_type`` NULL), in one
    pass."""
    return master.rollup("market_type").agg(F.count(F.lit(1)).alias("n"))


def market_counts_wide(master: DataFrame, markets=("KOSPI", "KOSDAQ")) -> DataFrame:
    """The wide shape ``{<market>: n, ..., total: n}`` as one row."""
    return master.agg(
        *[F.count_if(F.col("market_type") == m).alias(m.lower()) for m in markets],
        F.count(F.lit(1)).alias("total"))


# The per-code outcome of a collection run.
STATUSES = ("ok", "empty", "skipped", "partial", "failed")


def code_status(modes: DataFrame, plan: DataFrame, answers: DataFrame) -> DataFrame:
    """Outcome per code of one collection run.

    ``modes``: code, mode (from the planner). ``plan``: the windows that were
    to be fetched (code, seg_start, seg_end). ``answers``: the last answer of
    every window (code, seg_start, seg_end, ``rejected``, ``n_bars`` that
    could be read). A planned window without an answer counts as failed.
    skipped = nothing to fetch; failed = every window failed; partial = some
    did; empty = none did but there are no bars; ok = otherwise.
    """
    w = window_outcomes(plan, answers)
    per_code = w.groupBy("code").agg(
        F.count(F.lit(1)).alias("n_win"),
        F.count_if(~F.col("answered")).alias("n_bad"),
        F.sum("n_bars").alias("n_bars"))
    j = modes.select("code", "mode").join(per_code, "code", "left")
    n_win = F.coalesce("n_win", F.lit(0))
    n_bad = F.coalesce("n_bad", F.lit(0))
    n_bars = F.coalesce("n_bars", F.lit(0))
    status = (F.when((F.col("mode") == "skip") & (n_win == 0), "skipped")
               .when((n_win > 0) & (n_bad == n_win), "failed")
               .when(n_bad > 0, "partial")
               .when(n_bars == 0, "empty")
               .otherwise("ok"))
    return j.select("code", "mode", status.alias("status"),
                    n_win.cast("bigint").alias("n_windows"),
                    n_bars.cast("bigint").alias("n_bars"))


def window_outcomes(plan: DataFrame, answers: DataFrame) -> DataFrame:
    """Every planned window with ``answered`` and ``n_bars``: an answer whose
    window holds the planned one counts if it was not a reject in the end. A
    code has a few windows per run, so the join by code stays small."""
    keys = ["code", "seg_start", "seg_end"]
    a = answers.where(~F.col("rejected")).select(
        F.col("code").alias("a_code"), F.col("seg_start").alias("a_start"), F.col("seg_end").alias("a_end"), "n_bars")
    j = plan.select(*keys).join(a, (F.col("code") == F.col("a_code")) & (F.col("a_start") <= F.col("seg_start"))
                                & (F.col("a_end") >= F.col("seg_end")), "left")
    return j.groupBy(*keys).agg(F.count("a_code").cast("boolean").alias("answered"),
                                F.coalesce(F.max("n_bars"), F.lit(0)).cast("bigint").alias("n_bars"))


def run_summary(status: DataFrame) -> DataFrame:
    """One row: total and per-status counts; the parts always sum to total."""
    return status.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
