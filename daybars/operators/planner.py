"""Gap planner: which date windows still have to be fetched, per code.

Survey rows: G1-G5 J4 F6 F7 F17 F18 F22 P11 (D11, D12).

Windows are at most ``WINDOW_DAYS`` long and are counted back from the end
date; only the oldest window is clamped to the start. The planner is one
set-based DataFrame (left join + ``sequence``/``explode``), not a loop over
codes; each code yields at most ``ceil(days / 100)`` rows, so no group grows
with the data.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Window length, initial history and allowed backfill range.
WINDOW_DAYS = 100
INITIAL_DAYS = 500
MIN_DAYS, MAX_DAYS = 1, 2000
INTERVALS_PER_TASK = 1_000_000      # of the coverage, see _uncovered


def _date(d) -> _dt.date:
    if isinstance(d, _dt.datetime):
        return d.date()
    if isinstance(d, _dt.date):
        return d
    if isinstance(d, str):
        return _dt.date.fromisoformat(d)
    raise ValueError(f"as_of must be a date, got {d!r}")


def check_days(days) -> int:
    """Validate a backfill length: an int in 1..2000."""
    if isinstance(days, bool) or not isinstance(days, int):
        raise ValueError(f"days must be an integer, got {days!r}")
    if not MIN_DAYS <= days <= MAX_DAYS:
        raise ValueError(f"days must be in {MIN_DAYS}..{MAX_DAYS}, got {days}")
    return days


def _windows(ranges: DataFrame) -> DataFrame:
    """Cut ``[start, end]`` (inclusive) into windows counted back from end.

    ``ranges``: code, mode, start, end. Empty ranges (start > end) give no
    rows; ``sequence(0, -1)`` would count down, so it is never built.
    """
    n_days = F.datediff("end", "start") + 1
    n_win = F.ceil(n_days / F.lit(WINDOW_DAYS)).cast("int")
    idx = F.when(n_days > 0, F.sequence(F.lit(0), n_win - 1)).otherwise(F.array().cast("array<int>"))
    x = ranges.select("code", "mode", "start", "end", F.explode(idx).alias("i"))
    seg_end = F.date_sub("end", F.col("i") * WINDOW_DAYS)
    return x.select(
        "code", "mode", F.col("i").cast("int").alias("i"),
        F.greatest(F.date_sub(seg_end, WINDOW_DAYS - 1), F.col("start")).alias("seg_start"),
        seg_end.alias("seg_end"))


def plan_full(master: DataFrame, as_of, days: int) -> DataFrame:
    """Backfill of the last ``days`` days (ending at ``as_of``) for every code."""
    check_days(days)
    end = _date(as_of)
    start = end - _dt.timedelta(days=days - 1)
    r = master.select("code", F.lit("full").alias("mode"),
                      F.lit(start).alias("start"), F.lit(end).alias("end"))
    return _windows(r)


def latest_dates(bars: DataFrame) -> DataFrame:
    """MAX(date) per code (partial aggregate)."""
    return bars.groupBy("code").agg(F.max("date").alias("latest"))


def latest_from_summary(summary: DataFrame) -> DataFrame:
    """MAX(date) per code from a month summary (one row per code and month)."""
    return summary.groupBy("code").agg(F.max("date").alias("latest"))


def plan_modes(master: DataFrame, bars: DataFrame | None, as_of,
               latest: DataFrame | None = None) -> DataFrame:
    """Per code: ``initial`` (no bars), ``skip`` (already at/after as_of) or
    ``incremental``, with the range still to fetch. ``latest`` (code,
    latest) replaces the scan of ``bars`` when given."""
    end = _date(as_of)
    lt = latest if latest is not None else latest_dates(bars)
    j = master.select("code").join(lt, "code", "left")
    start = F.when(F.col("latest").isNull(), F.lit(end - _dt.timedelta(days=INITIAL_DAYS - 1))) \
             .otherwise(F.date_add("latest", 1))
    mode = (F.when(F.col("latest").isNull(), F.lit("initial"))
             .when(F.date_add("latest", 1) > F.lit(end), F.lit("skip"))
             .otherwise(F.lit("incremental")))
    return j.select("code", mode.alias("mode"), "latest",
                    start.alias("start"), F.lit(end).alias("end"))


def plan_initial(master: DataFrame, bars: DataFrame, as_of) -> DataFrame:
    """The 500-day, five-window plan for codes that have no bars yet."""
    m = plan_modes(master, bars, as_of)
    return _windows(m.where(F.col("mode") == "initial"))


def plan_incremental(master: DataFrame, bars: DataFrame | None, as_of,
                     latest: DataFrame | None = None) -> DataFrame:
    """Combined plan over all codes: initial windows for new codes, windows
    from the day after the latest bar up to ``as_of`` (inclusive day count)
    for the others; up-to-date codes get none."""
    m = plan_modes(master, bars, as_of, latest)
    return _windows(m.where(F.col("mode") != "skip"))


def plan_mode_counts(master: DataFrame, bars: DataFrame, as_of) -> DataFrame:
    """Number of codes and of windows per mode."""
    m = plan_modes(master, bars, as_of)
    n_days = F.datediff("end", "start") + 1
    n_win = F.when(F.col("mode") == "skip", 0).otherwise(F.ceil(n_days / F.lit(WINDOW_DAYS)))
    return (m.groupBy("mode")
             .agg(F.count(F.lit(1)).alias("n_codes"),
                  F.sum(n_win).cast("bigint").alias("n_windows")))


def _signed(df: DataFrame, wanted, covers) -> DataFrame:
    """``df`` (code, start, end) as intervals that count ``wanted`` times as wanted
    and ``covers`` times as covered; empty ones (start > end) are gone."""
    return (df.where(F.col("start") <= F.col("end"))
              .select("code", "start", "end", wanted.cast("int").alias("w"), covers.cast("int").alias("c")))


def _uncovered(signed: DataFrame) -> DataFrame:
    """(code, start, end): the days that an interval of ``signed`` wants and none
    covers, as maximal intervals.

    The intervals are written, so that their number is known, and dealt out by
    code over partitions of about ``INTERVALS_PER_TASK`` at most. The number is given as
    such: intervals are made from a few bytes a code, so neither the size of what they
    are made from nor their own, compressed, says how many meet in a task.

    Every interval is two signed steps; steps of one day are added up first, so
    repeated fetches shrink to one row per day, and running sums per code say
    where something is wanted and nothing covers.
    """
    from daybars.sources.tables import counted

    signed, n = counted(signed, "intervals")
    n_tasks = max(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // INTERVALS_PER_TASK))
    step = F.explode(F.array(
        F.struct(F.col("start").alias("day"), F.col("w").alias("w"), F.col("c").alias("c")),
        F.struct(F.date_add("end", 1).alias("day"), (-F.col("w")).alias("w"), (-F.col("c")).alias("c"))))
    at = (signed.repartition(n_tasks, "code").select("code", step.alias("s")).select("code", "s.*")
                .groupBy("code", "day").agg(F.sum("w").alias("w"), F.sum("c").alias("c")))
    order = Window.partitionBy("code").orderBy("day")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # after the last step nothing is wanted, so every opening has its closing
    open_ = at.select("code", "day", ((F.sum("w").over(so_far) > 0) & (F.sum("c").over(so_far) <= 0)).alias("gap"))
    turns = (open_.select("*", F.lag("gap", 1, False).over(order).alias("before"))
                  .where(F.col("gap") != F.col("before")))
    return (turns.select("code", "gap", F.col("day").alias("start"), F.date_sub(F.lead("day").over(order), 1).alias("end"))
                 .where("gap").select("code", "start", "end"))


def interval_difference(wanted: DataFrame, covered: DataFrame) -> DataFrame:
    """(code, start, end): the days of ``wanted`` that ``covered`` does not
    hold, as maximal intervals.

    Both are sets of (code, start, end), days inclusive, which may overlap,
    touch and repeat; empty intervals (start > end) count for nothing.
    """
    return _uncovered(_signed(wanted, F.lit(1), F.lit(0)).unionByName(_signed(covered, F.lit(0), F.lit(1))))


def gap_windows(ranges: DataFrame, coverage: DataFrame, mode: str = "gap") -> DataFrame:
    """Windows for every required day that no answered window covers.

    ``ranges``: code, start, end (required days, inclusive; any number a code).
    ``coverage``: code, seg_start, seg_end (answered windows). Unlike a plan
    from MAX(date), a window that failed inside the history is planned again.
    """
    covered = coverage.select("code", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))
    gaps = interval_difference(ranges.select("code", "start", "end"), covered)
    return _windows(gaps.withColumn("mode", F.lit(mode)).select("code", "mode", "start", "end"))


def plan_gaps(master: DataFrame, coverage: DataFrame, as_of, days: int = INITIAL_DAYS) -> DataFrame:
    """Coverage-based plan: every code must hold the last ``days`` days up to
    ``as_of``; plan the days no answered window covers."""
    check_days(days)
    end = _date(as_of)
    r = master.select("code", F.lit(end - _dt.timedelta(days=days - 1)).alias("start"),
                      F.lit(end).alias("end"))
    return gap_windows(r, coverage)


def replan_failed(plan: DataFrame, coverage: DataFrame, master: DataFrame) -> DataFrame:
    """``plan`` and, as mode ``gap``, every day of a failed window that no
    answered window and no window of ``plan`` holds, for codes of ``master``.

    ``coverage`` is (code, seg_start, seg_end, answered). Days that failed
    several times are planned once; days answered since, by whatever window,
    are not planned again. The codes meet the master after their windows have been
    dealt out, not before.
    """
    asked = coverage.where("answered IS NOT NULL").select(
        "code", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), "answered")
    planned = plan.select("code", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))
    gaps = _uncovered(_signed(asked, ~F.col("answered"), F.col("answered"))
                      .unionByName(_signed(planned, F.lit(0), F.lit(1)))).join(master.select("code"), "code", "left_semi")
    return plan.unionByName(_windows(gaps.withColumn("mode", F.lit("gap")).select("code", "mode", "start", "end")).select(*plan.columns))
