"""Stored tables: Parquet folders that keyed merges rewrite in parts.

Survey rows: S3 S4 S6 S7 S8 O1 J6 Q1-Q5 (checks at write).

A table is a folder partitioned by one column: by ``month`` (bars, features,
summary, coverage) or, for tables of one row per code (master, latest bars),
by a constant ``part``. A write replaces whole partitions with Spark's dynamic
partition overwrite: tasks write beside the table, and the driver puts the finished
partitions in place at the end. So a plan may read the partitions that it
replaces, lost executors only repeat tasks, and a job that fails changes nothing.
Rows reach a table through :func:`merge_months` or :func:`merge_table`, which
are idempotent: a run that died is run again.

One writer a table at a time; a reader at work while a partition is replaced may
have to start again. Where a table format is at hand, its ``MERGE INTO`` takes the
same change sets and lifts both limits.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MONTH, _PART = "month", "part"

# Larger change sets are not sent whole to every task: their files are small, as codes
# and dates compress, but the table in a task's memory takes some 170 bytes a row.
BROADCAST_ROWS = 500_000


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _partitions(spark: SparkSession, root: str, column: str) -> list[str]:
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(column + "="))


def _read(spark: SparkSession, root: str, schema: StructType, column: str, values: Iterable[str] | None) -> DataFrame:
    have = _partitions(spark, root, column)
    want = have if values is None else sorted(set(have) & set(values))
    if not want:
        return spark.createDataFrame([], schema)
    if values is None:
        return spark.read.schema(schema).parquet(root).select(*schema.fieldNames())
    return spark.read.schema(schema).parquet(*[f"{root.rstrip('/')}/{column}={v}" for v in want])


def _replace(out: DataFrame, root: str, column: str, values: Sequence[str]) -> None:
    """``out`` (with ``column``) becomes the whole content of these partitions;
    those it has no rows for go."""
    spark = out.sparkSession
    seen = Observation(f"written-{uuid.uuid4().hex}")
    writer = out.observe(seen, F.collect_set(column).alias("filled")).write.mode("overwrite")
    if "code" in out.columns:
        writer = writer.option("parquet.bloom.filter.enabled#code", "true").option("parquet.bloom.filter.expected.ndv#code", "20000")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(root)
    filled = set(seen.get["filled"] or [])
    for v in set(values) & set(_partitions(spark, root, column)) - filled:
        fs, p = _fs(spark, f"{root.rstrip('/')}/{column}={v}")
        fs.delete(p, True)


# ------------------------------------------------------------ whole tables
def read_table(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The table; an empty frame when there is none."""
    return _read(spark, root, schema, _PART, None)


def write_table(df: DataFrame, root: str, sort_by: Sequence[str] | None = None) -> None:
    """``df`` as the whole table; it may be built on the table itself.

    ``sort_by`` clusters rows inside each file, so Parquet min/max statistics
    skip row groups on key predicates.
    """
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    _replace(out.withColumn(_PART, F.lit("all")), root, _PART, ["all"])


# ------------------------------------------------------- month-partitioned
def month_key(d) -> str:
    return f"{d.year:04d}-{d.month:02d}"


def _keys(months: Iterable) -> list[str]:
    return sorted({m if isinstance(m, str) else month_key(m) for m in months})


def stored_months(spark: SparkSession, root: str) -> list[str]:
    """'YYYY-MM' of every month that has rows."""
    return _partitions(spark, root, _MONTH)


def read_months(spark: SparkSession, root: str, schema: StructType, months: Iterable | None = None) -> DataFrame:
    """The table, or only ``months`` (dates or 'YYYY-MM' keys): other months
    are pruned before any file is opened."""
    return _read(spark, root, schema, _MONTH, None if months is None else _keys(months))


def write_months(df: DataFrame, root: str, months: Iterable, date_col: str = "date",
                 sort_by: Sequence[str] | None = None, cluster: bool = True) -> None:
    """Write ``df`` as the new content of ``months`` (every row of ``df``
    must fall in one of them); months without rows become empty. ``df`` may be
    built on those months of the table.

    cluster   deal rows out by range of (month, first sort column), so a
              month's files hold disjoint ranges of codes; it samples ``df``.
              Otherwise by month, small months packed together (REBALANCE).

    Parquet bloom filters on ``code`` let a search skip the row groups whose
    range holds its code by chance.
    """
    out = df.withColumn(_MONTH, F.date_format(F.col(date_col), "yyyy-MM"))
    out = out.repartitionByRange(_MONTH, *(sort_by or [])[:1]) if cluster else out.hint("rebalance", _MONTH)
    out = out.sortWithinPartitions(_MONTH, *(sort_by or []))
    _replace(out, root, _MONTH, _keys(months))


def changed_months(changes: DataFrame, date_col: str = "date") -> list[_dt.date]:
    """Distinct months of a change set (a short list: one entry per month,
    at most a few hundred even for the longest backfill)."""
    rows = (changes.select(F.trunc(F.col(date_col), "month").alias("m"))
                   .distinct().collect())
    return sorted(r["m"] for r in rows if r["m"] is not None)


def merge_months(spark: SparkSession, root: str, changes: DataFrame, keys: Sequence[str],
                 schema: StructType, date_col: str = "date",
                 sort_by: Sequence[str] | None = None, months: Iterable | None = None) -> None:
    """Keyed upsert of ``changes`` into a month-partitioned table, rewriting
    only the months the changes fall in (``months`` when the caller already
    knows them). Pass a materialised change set (it is read more than once).
    Its rows are counted (file footers): beyond ``BROADCAST_ROWS`` they meet the
    table in a sort merge join, whatever the size of their files."""
    from daybars.operators.keyed import upsert

    months = changed_months(changes, date_col) if months is None else list(months)
    if months:
        old = read_months(spark, root, schema, months)
        if changes.count() > BROADCAST_ROWS:
            changes = changes.hint("merge")
        write_months(upsert(old, changes.select(*schema.fieldNames()), keys), root, months, date_col, sort_by)


def delete_keys(spark: SparkSession, root: str, schema: StructType, removed: DataFrame, key: str = "code",
                date_col: str = "date", sort_by: Sequence[str] | None = None,
                where: DataFrame | None = None) -> list[_dt.date]:
    """Rows whose ``key`` is in ``removed`` go; only months that hold such
    rows are rewritten, and returned. ``where`` (key, date column) says in which months
    they are, if a smaller table knows; otherwise the keys are scanned."""
    from daybars.operators.keyed import cascade_delete

    rows = read_months(spark, root, schema).select(key, date_col) if where is None else where
    months = changed_months(rows.join(removed.select(key), key, "left_semi"), date_col)
    if months:
        left = cascade_delete(read_months(spark, root, schema, months), removed, key)
        write_months(left.select(*schema.fieldNames()), root, months, date_col, sort_by)
    return months


# ----------------------------------------------------------- checks at write
class BrokenConstraint(ValueError):
    """A change set breaks a constraint of its table; nothing was written."""


def checks_of(schema: StructType, lengths: dict | None = None, domain: tuple | None = None) -> dict[str, Column]:
    """Counts of rows that break a constraint: NOT NULL of the schema, length
    limits and a domain (column, values)."""
    out = {f"null_{f.name}": F.count_if(F.col(f.name).isNull()) for f in schema.fields if not f.nullable}
    out |= {f"len_{c}": F.count_if(F.length(c) > n) for c, n in (lengths or {}).items() if c in schema.fieldNames()}
    if domain:
        out[f"domain_{domain[0]}"] = F.count_if(~F.col(domain[0]).isin(*domain[1]))
    return out


def materialised(df: DataFrame, tbl: str, checks: dict[str, Column] | None = None,
                 checks_root: str | None = None, run_id: str | None = None) -> DataFrame:
    """``df`` written to the shared folder, with its constraints counted by the
    write itself.

    Its plan is cut and its size known. The counts are appended to
    ``checks_root`` as rows (tbl, check_name, n_bad, n_rows, run); any that
    is not zero raises :class:`BrokenConstraint`. Checked change sets merged into a
    table that meets its constraints leave one that does, so the table need not be
    scanned.
    """
    from daybars.session import scratch_dir

    spark, path = df.sparkSession, scratch_dir(df.sparkSession, tbl)
    if not checks:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    seen = Observation(f"checks-{uuid.uuid4().hex}")
    rows = F.count(F.lit(1)).alias("n_rows")
    df.observe(seen, rows, *[c.alias(k) for k, c in checks.items()]).write.parquet(path)
    found = seen.get
    if checks_root is not None:
        report = [(tbl, k, int(found[k]), int(found["n_rows"]), run_id or "") for k in checks]
        (spark.createDataFrame(report, "tbl string, check_name string, n_bad bigint, n_rows bigint, run string")
              .coalesce(1).write.mode("append").parquet(checks_root))
    bad = {k: found[k] for k in checks if found[k]}
    if bad:
        raise BrokenConstraint(f"{tbl}: " + ", ".join(f"{k}: {n}" for k, n in bad.items()))
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, tbl: str) -> tuple[DataFrame, int]:
    """``df`` written to the shared folder, and its number of rows as counted by
    the write itself."""
    from daybars.session import scratch_dir

    spark, path = df.sparkSession, scratch_dir(df.sparkSession, tbl)
    seen = Observation(f"counted-{uuid.uuid4().hex}")
    df.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), int(seen.get["n_rows"])


# ------------------------------------------------------------------ features
def refresh_feature_months(spark: SparkSession, features_root: str, bars: DataFrame,
                           changes: DataFrame, schema: StructType,
                           bars_root: str | None = None,
                           bars_schema: StructType | None = None,
                           summary: DataFrame | None = None) -> list | None:
    """Refresh a month-partitioned features table after ``changes`` were
    merged into ``bars``: only the months holding a touched (code, month)
    are rewritten. Returns them, or None when nothing was touched.

    The touched pairs and their seed rows (small: proportional to the change
    set) are materialised once in the checkpoint folder; listing their months
    and recomputing them then reuse it. With ``bars_root`` the recomputed rows
    are read from the touched months only.
    """
    from daybars.operators.features import replace_months, touched_refresh
    from daybars.session import checkpoint_dir

    checkpoint_dir(spark)
    month_rows = None
    if bars_root is not None:
        def month_rows(ms):
            return read_months(spark, bars_root, bars_schema, ms)
    months, fresh, ms = touched_refresh(bars, changes, materialise=True, month_rows=month_rows, summary=summary)
    if not ms:
        return None
    old = read_months(spark, features_root, schema, ms)
    write_months(replace_months(old, months, fresh), features_root, ms, sort_by=["code", "date"])
    return ms


# --------------------------------------------- one row per month, one per code
def write_summary(spark: SparkSession, bars_root: str, summary_root: str, months: Iterable,
                  bars_schema: StructType) -> None:
    """Summarise the given months of the bars: one row per (code, month), its
    last bar."""
    from daybars.operators.features import month_summary

    bars = read_months(spark, bars_root, bars_schema, months)
    write_months(month_summary(bars), summary_root, months, date_col="_bkt", sort_by=["code"], cluster=False)


def read_summary(spark: SparkSession, bars_root: str, summary_root: str, bars_schema: StructType) -> DataFrame:
    """The month summary: about one row per (code, month) instead of the
    history. Months of bars that have no summary yet are summarised on the fly."""
    from daybars.operators.features import SUMMARY, month_summary

    stored = read_months(spark, summary_root, SUMMARY)
    missing = set(stored_months(spark, bars_root)) - set(stored_months(spark, summary_root))
    if not missing:
        return stored
    return stored.unionByName(month_summary(read_months(spark, bars_root, bars_schema, missing)))


def merge_latest(spark: SparkSession, latest_root: str, changes: DataFrame, schema: StructType) -> None:
    """Take a change set of bars into the table of every code's latest bar: a
    change replaces a bar of its own day and any older one."""
    from daybars.operators.aggregates import latest_bar

    place = F.datediff("date", F.lit(_dt.date(1970, 1, 1))) * 2
    old = read_table(spark, latest_root, schema).withColumn("_place", place)
    new = latest_bar(changes).select(*schema.fieldNames()).withColumn("_place", place + 1)
    vals = [c for c in schema.fieldNames() if c != "code"]
    merged = old.unionByName(new).groupBy("code").agg(*[F.max_by(c, "_place").alias(c) for c in vals])
    write_table(merged.select(*schema.fieldNames()), latest_root, sort_by=["code"])


def rebuild_latest(spark: SparkSession, bars_root: str, latest_root: str, schema: StructType) -> None:
    """The latest-bar table from all bars."""
    from daybars.operators.aggregates import latest_bar

    write_table(latest_bar(read_months(spark, bars_root, schema)).select(*schema.fieldNames()), latest_root, sort_by=["code"])
