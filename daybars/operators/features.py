"""Day-over-day change-rate features.

Survey rows: W1 W2 W3 J1 J2 A2 P1 P6 P7 F1 F2.

"Previous" always means the previous *existing* bar of the same code, not
the previous calendar day.

Scale notes
-----------
``(code, date)`` is unique, so a code has one row per day, some ten thousand
in a lifetime, however large the table is. A plain ``LAG`` window over the
code is therefore bounded per group, and it is one scan and one shuffle.
A refresh after a change set first restricts everything to the changed codes
(a small, materialised table that Spark broadcasts), then to the months a
change can affect.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybars.functions.rates import pct_change
from daybars.schemas import BAR_VALUES

_BKT = "_bkt"
_VIRT = "_virtual"

# One row per (code, month): the month and its last bar.
SUMMARY = T.StructType([
    T.StructField("code", T.StringType(), True),
    T.StructField(_BKT, T.DateType(), True),
    T.StructField("date", T.DateType(), True),
    *[T.StructField(c, T.LongType() if c == "volume" else T.DoubleType(), True) for c in BAR_VALUES],
])


def month_summary(bars: DataFrame) -> DataFrame:
    """Last bar of every (code, month): a partial hash aggregate."""
    return bars.groupBy(F.col("code"), F.trunc(F.col("date"), "month").alias(_BKT)).agg(
        *[F.max_by(c, "date").alias(c) for c in ["date", *BAR_VALUES]])


def with_previous(bars: DataFrame, cols=BAR_VALUES, key: str = "code",
                  order: str = "date", prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>`` (value of the previous existing row of the same key)
    for every ``c`` in ``cols`` plus ``prev_<order>``.

    ``(key, order)`` must be unique, as it is for bars and features.
    """
    w = Window.partitionBy(key).orderBy(order)
    carried = [order] + [c for c in cols if c != order]
    return bars.select("*", *[F.lag(c).over(w).alias(f"{prefix}{c}") for c in carried])


def _rates(cur: str = "", prev: str = "prev_") -> list:
    return [pct_change(F.col(f"{cur}{c}"), F.col(f"{prev}{c}")).alias(f"{c}_change_rate")
            for c in BAR_VALUES]


def features_full(bars: DataFrame) -> DataFrame:
    """Rates for every bar that has a previous bar (full-history rebuild)."""
    p = with_previous(bars.select("code", "date", *BAR_VALUES))
    return (p.where(F.col("prev_close").isNotNull())
             .select("code", "date", *_rates()))


def _as_date(d) -> F.Column:
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


def prev_bar(bars: DataFrame, as_of) -> DataFrame:
    """Latest bar per code strictly before ``as_of``.

    Equivalent to the correlated ``MAX(date) ... WHERE date < as_of`` but
    computed as one partial hash aggregate (no self-join): per-column
    ``max_by`` over a unique ``(code, date)`` picks one consistent row. The
    date predicate reaches the Parquet scan.
    """
    return (bars.where(F.col("date") < _as_date(as_of))
                .groupBy("code")
                .agg(F.max("date").alias("prev_date"),
                     *[F.max_by(c, "date").alias(c) for c in BAR_VALUES]))


def features_as_of(bars: DataFrame, as_of) -> DataFrame:
    """Rates for the bars dated exactly ``as_of`` against each code's previous
    bar. Codes without a previous bar give no row."""
    today = bars.where(F.col("date") == _as_date(as_of)).select("code", "date", *BAR_VALUES)
    prev = prev_bar(bars, as_of).select(
        "code", *[F.col(c).alias(f"prev_{c}") for c in BAR_VALUES])
    return today.join(prev, "code", "inner").select("code", "date", *_rates())


def prev_bar_from_summary(summary: DataFrame, month_bars: DataFrame, as_of) -> DataFrame:
    """:func:`prev_bar` without reading the history: the candidates are each
    code's month summaries before ``as_of``'s month and the bars of that month
    dated before ``as_of``; the latest candidate wins. ``month_bars`` needs
    only the bars of ``as_of``'s month."""
    d = _as_date(as_of)
    month = F.trunc(d, "month")
    cols = ["code", "date", *BAR_VALUES]
    cand = (summary.where(F.col(_BKT) < month).select(*cols)
                   .unionByName(month_bars.where((F.col("date") < d) & (F.col("date") >= month))
                                          .select(*cols)))
    return (cand.groupBy("code")
                .agg(F.max("date").alias("prev_date"),
                     *[F.max_by(c, "date").alias(c) for c in BAR_VALUES]))


def features_as_of_summary(summary: DataFrame, month_bars: DataFrame, as_of) -> DataFrame:
    """:func:`features_as_of` from a month summary plus the bars of
    ``as_of``'s month: the single-date refresh without a history scan."""
    today = month_bars.where(F.col("date") == _as_date(as_of)).select("code", "date", *BAR_VALUES)
    prev = prev_bar_from_summary(summary, month_bars, as_of).select(
        "code", *[F.col(c).alias(f"prev_{c}") for c in BAR_VALUES])
    return today.join(prev, "code", "inner").select("code", "date", *_rates())


def _touched_lasts(bars: DataFrame, changes: DataFrame, key: str, order: str,
                   carried: list) -> DataFrame:
    """Per (key, month) of the merged bars: its last row, whether a change
    falls in it (``_chg``), whether it must be recomputed (``_touched``: it
    holds a change, or the previous non-empty month does) and whether it
    must seed the next month (``_seed``). One partial aggregate over bars
    plus change keys, one window over one row per (key, month)."""
    month = F.trunc(F.col(order), "month").alias(_BKT)
    flagged = (bars.select(key, order, *[c for c in carried if c != order], F.lit(False).alias("_c"))
                   .unionByName(changes.select(key, order, F.lit(True).alias("_c")),
                                allowMissingColumns=True))
    real = F.when(~F.col("_c"), F.col(order))          # NULL ordering: skipped by max_by
    lasts = flagged.groupBy(F.col(key), month).agg(
        *[F.max_by(c, real).alias(c) for c in carried], F.max("_c").alias("_chg"))
    wb = Window.partitionBy(key).orderBy(_BKT)
    nxt_chg = F.coalesce(F.lead("_chg").over(wb), F.lit(False))
    prev_chg = F.coalesce(F.lag("_chg").over(wb), F.lit(False))
    return (lasts.select("*", F.lead(_BKT).over(wb).alias("_next"),
                         (F.col("_chg") | prev_chg).alias("_touched"),
                         (F.col("_chg") | nxt_chg).alias("_seed")))


def _touched_from_summary(summary: DataFrame, changes: DataFrame) -> DataFrame:
    """Same output as :func:`_touched_lasts`, from a month summary of the
    merged bars instead of the bars: the change flag is joined onto one row
    per (code, month) (the flag set is small)."""
    chg = (changes.select("code", F.trunc(F.col("date"), "month").alias(_BKT)).distinct()
                  .withColumn("_chg", F.lit(True)))
    lasts = (summary.join(chg, ["code", _BKT], "left")
                    .withColumn("_chg", F.coalesce("_chg", F.lit(False))))
    wb = Window.partitionBy("code").orderBy(_BKT)
    nxt_chg = F.coalesce(F.lead("_chg").over(wb), F.lit(False))
    prev_chg = F.coalesce(F.lag("_chg").over(wb), F.lit(False))
    return (lasts.select("*", F.lead(_BKT).over(wb).alias("_next"),
                         (F.col("_chg") | prev_chg).alias("_touched"),
                         (F.col("_chg") | nxt_chg).alias("_seed")))


def touched_months(bars: DataFrame, changes: DataFrame, key: str = "code",
                   order: str = "date") -> DataFrame:
    """The (key, month) groups whose features a change set can affect: every
    month holding a changed row, and the key's next non-empty month after
    it (its first row's previous bar may have changed). ``bars`` is the
    merged table. Returns (key, _bkt)."""
    t = _touched_lasts(bars, changes, key, order, [order])
    return t.where("_touched").select(key, _BKT)


def changed_codes(changes: DataFrame) -> DataFrame:
    """The codes of a change set, written to the shared folder: its size is
    then known, so Spark broadcasts it wherever it is small."""
    from daybars.session import scratch_dir

    spark = changes.sparkSession
    path = scratch_dir(spark, "codes")
    changes.where("code IS NOT NULL").select("code").distinct().write.parquet(path)
    return spark.read.schema("code string").parquet(path)


def touched_refresh(bars: DataFrame, changes: DataFrame, materialise: bool = False,
                    month_rows=None, summary: DataFrame | None = None):
    """Recompute the touched months. Returns ``(months, fresh, listed)``: the
    touched (code, ``_bkt``) pairs, their recomputed feature rows and, with
    ``materialise``, the list of those months.

    Everything is restricted to the changed codes before it is aggregated.
    ``materialise`` checkpoints the touched and seed rows (one row per
    affected (code, month)) so that callers using ``months`` more than once
    do not recompute the month aggregate. ``month_rows(months_list)`` may
    return a month-pruned read of the bars for the recomputed rows. The last
    bar before a touched month can be arbitrarily old; a month ``summary`` of
    the merged bars gives it without reading the changed codes' history."""
    key, order = "code", "date"
    carried = [order, *BAR_VALUES]
    codes = changed_codes(changes)
    b = bars.select(key, order, *BAR_VALUES).join(codes, key, "left_semi")
    if summary is not None:
        t = _touched_from_summary(summary.join(codes, key, "left_semi"), changes)
    else:
        t = _touched_lasts(b, changes, key, order, carried)
    listed = None
    if materialise:
        t = t.where(F.col("_touched") | F.col("_seed")).checkpoint(eager=True)
    months = t.where("_touched").select(key, _BKT)
    seeds = t.where(F.col("_seed") & F.col("_next").isNotNull())
    src = b
    if materialise:
        listed = sorted(r[_BKT] for r in months.select(_BKT).distinct().collect())
        if month_rows is not None:
            src = month_rows(listed).select(key, order, *BAR_VALUES).join(codes, key, "left_semi")
    rows = (src.withColumn(_BKT, F.trunc(F.col(order), "month"))
               .join(months, [key, _BKT], "left_semi").drop(_BKT).withColumn(_VIRT, F.lit(False)))
    # A seed is the last bar before a touched month; it stands in the window
    # only to be the previous row. If it was recomputed itself it is there
    # twice with equal values.
    rows = rows.unionByName(seeds.select(*rows.columns[:-1], F.lit(True).alias(_VIRT)))
    w = Window.partitionBy(key).orderBy(order, _VIRT)
    p = (rows.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in BAR_VALUES])
             .where(~F.col(_VIRT) & F.col("prev_close").isNotNull()))
    return months, p.select(key, order, *_rates()), listed


def replace_months(features: DataFrame, months: DataFrame, fresh: DataFrame) -> DataFrame:
    """Features outside the touched (code, month) pairs, plus the fresh rows."""
    kept = (features.withColumn(_BKT, F.trunc(F.col("date"), "month"))
                    .join(months, ["code", _BKT], "left_anti")
                    .drop(_BKT))
    return kept.unionByName(fresh.select(*features.columns))


def changed_since(changes: DataFrame) -> DataFrame:
    """(code, since): the first changed day of every changed code, written to
    the shared folder: its size is then known, so Spark broadcasts it wherever
    it is small."""
    from daybars.session import scratch_dir

    spark = changes.sparkSession
    path = scratch_dir(spark, "since")
    changes.where("code IS NOT NULL").groupBy("code").agg(F.min("date").alias("since")).write.parquet(path)
    return spark.read.schema("code string, since date").parquet(path)


def features_since(bars: DataFrame, since: DataFrame) -> DataFrame:
    """Features of the given codes from their day ``since`` on.

    Only those days are exchanged, once, for the window. Of everything before
    them a partial aggregate leaves each code's last bar, which stands in the
    window to be the first day's previous row.
    """
    b = bars.select("code", "date", *BAR_VALUES).join(since, "code")
    early = F.col("date") < F.col("since")
    seeds = b.where(early).groupBy("code").agg(*[F.max_by(c, "date").alias(c) for c in ("date", *BAR_VALUES)])
    rows = (b.where(~early).select("code", "date", *BAR_VALUES, F.lit(True).alias("_wanted"))
             .unionByName(seeds.withColumn("_wanted", F.lit(False))))
    p = with_previous(rows).where(F.col("_wanted") & F.col("prev_close").isNotNull())
    return p.select("code", "date", *_rates())


def features_touched(features: DataFrame, bars: DataFrame, changes: DataFrame,
                     summary: DataFrame | None = None) -> DataFrame:
    """Refresh ``features`` after ``changes`` were merged into ``bars``.

    Bars are only added or replaced, so a change can alter features of its
    code from its day on and no others. Those are computed anew
    (:func:`features_since`); all others are kept, by a comparison with the
    code's first changed day and without an exchange while the changed codes
    can be broadcast. The result equals a full rebuild. With a month ``summary``
    of the merged bars only the touched months are (see :func:`touched_months`),
    and their previous bars come from the summary.
    """
    if summary is not None:
        months, fresh, _ = touched_refresh(bars, changes, summary=summary)
        return replace_months(features, months, fresh)
    since = changed_since(changes)
    kept = (features.join(since, "code", "left")
                    .where(F.col("since").isNull() | (F.col("date") < F.col("since"))))
    return kept.select(*features.columns).unionByName(features_since(bars, since).select(*features.columns))


def bars_before(probes: DataFrame, bars: DataFrame, inclusive: bool = False) -> DataFrame:
    """Every row of ``probes`` (code, date and any other columns) with its
    code's latest bar before that date (``inclusive``: on or before), as
    ``prev_date`` and ``prev_<value>``; NULL where there is none. Null codes
    and dates meet no bar.

    An as-of join against a table of dates: bars and the distinct probed days are
    one union, exchanged and sorted once by (code, date), in which the last
    bar is carried forward. A code has one row per day on either side however often
    it is probed; repeated probes meet their day in an equi-join, which AQE
    splits where one code is hot.
    """
    none = [F.lit(None).cast(bars.schema[c].dataType).alias(f"prev_{c}") for c in ("date", *BAR_VALUES)]
    days = probes.select("code", "date").where("code IS NOT NULL AND date IS NOT NULL").distinct()
    # at equal dates a probe comes before the bar, inclusive after it
    place = 0 if inclusive else 1
    both = (bars.select("code", "date", F.lit(place).alias("_bar"), *[F.col(c).alias(f"prev_{c}") for c in ("date", *BAR_VALUES)])
                .unionByName(days.select("code", "date", F.lit(1 - place).alias("_bar"), *none)))
    so_far = Window.partitionBy("code").orderBy("date", "_bar").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.select("code", "date", "_bar", F.last("prev_date", ignorenulls=True).over(so_far).alias("prev_date"),
                        *[F.last(F.when(F.col("_bar") == place, F.struct(f"prev_{c}")), ignorenulls=True).over(so_far)[f"prev_{c}"].alias(f"prev_{c}")
                          for c in BAR_VALUES])
    return probes.join(found.where(F.col("_bar") == 1 - place).drop("_bar"), ["code", "date"], "left")
