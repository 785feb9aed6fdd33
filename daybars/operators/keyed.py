"""Keyed de-duplication and upsert (merge) as DataFrame transformations.

Survey rows: A4 J6 J7 S6 S7 S8 S9 (D5 D6).

Spark has no ``MERGE`` on plain Parquet; an upsert here is a pure function
``(base, changes) -> merged`` that the table sink then writes to a new
version directory. Both sides shuffle on the key once; keys are unique on
each side after :func:`keep_last`, so no key can be hot.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_PRIMITIVE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType,
              T.TimestampType, T.TimestampNTZType)


def keep_last(df: DataFrame, keys: Sequence[str], order) -> DataFrame:
    """One row per key: the one with the greatest ``order`` (later wins).

    ``order`` is a column name or Column; a row without order loses to any
    other and wins only if it is alone. ``max_by`` aggregates partially before
    the shuffle, so a key holding a third of all rows is reduced map-side;
    ``dropDuplicates`` would not be deterministic.

    Where the order and all values are fixed-width (see
    ``sources.quotes.ranked`` for a bigint arrival order), each column has a
    ``max_by`` of its own and the plan is a hash aggregate; all pick the same row, as
    they see the same orders. Texts and structs need one ``max_by`` over a struct, which
    sorts.
    """
    keys = list(keys)
    order_col = F.col(order) if isinstance(order, str) else order
    vals = [c for c in df.columns if c not in keys]
    kinds = [df.select(order_col.alias("o")).schema[0].dataType, *(df.schema[c].dataType for c in vals)]
    if all(isinstance(k, _PRIMITIVE) for k in kinds):
        known = F.max(order_col).isNotNull()
        return df.groupBy(*keys).agg(*[
            F.when(known, F.max_by(c, order_col)).otherwise(F.first(c)).alias(c) for c in vals])
    order_col = F.struct(order_col.isNotNull().alias("known"), order_col.alias("order"))
    return (df.groupBy(*keys)
              .agg(F.max_by(F.struct(*vals), order_col).alias("_row"))
              .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in vals]))


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``changes`` replace rows of ``base`` with the same key; other
    base rows are kept; new keys are added. ``changes`` must be unique on
    ``keys`` (apply :func:`keep_last` first). Idempotent:
    ``upsert(upsert(b, c), c) == upsert(b, c)``."""
    keys = list(keys)
    changes = changes.select(*base.columns)
    kept = base.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes)


def upsert_with_audit(base: DataFrame, changes: DataFrame, keys: Sequence[str],
                      run_ts, created: str = "created_at",
                      updated: str = "updated_at") -> DataFrame:
    """Upsert that also maintains ``created_at`` / ``updated_at``.

    A written row keeps the base ``created_at`` (or gets ``run_ts`` when new)
    and gets ``updated_at = run_ts``; untouched rows keep both. One
    full-outer join on the key does match and merge in a single shuffle.
    """
    keys = list(keys)
    ts = run_ts if isinstance(run_ts, Column) else F.lit(run_ts)
    vals = [c for c in base.columns if c not in keys and c not in (created, updated)]
    c = changes.select(*keys, *vals).withColumn("_hit", F.lit(True))
    j = base.alias("b").join(c.alias("c"), keys, "full_outer")
    hit = F.col("c._hit").isNotNull()
    out = [F.col(k) for k in keys]
    out += [F.when(hit, F.col(f"c.{v}")).otherwise(F.col(f"b.{v}")).alias(v) for v in vals]
    out.append(F.when(hit, F.coalesce(F.col(f"b.{created}"), ts))
                .otherwise(F.col(f"b.{created}")).alias(created))
    out.append(F.when(hit, ts).otherwise(F.col(f"b.{updated}")).alias(updated))
    return j.select(*out).select(*base.columns)


def cascade_delete(children: DataFrame, removed: DataFrame, key: str = "code") -> DataFrame:
    """Drop child rows whose parent key was removed (ON DELETE CASCADE)."""
    return children.join(removed.select(key), key, "left_anti")
