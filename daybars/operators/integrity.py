"""Constraints a Spark table does not enforce: unique keys, NOT NULL,
length limits, value domains and foreign keys. Each check is one
aggregate pass; results are long-form rows ``(tbl, check_name, n_bad)``.

Survey rows: J5 J6 Q1-Q6.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybars.schemas import LENGTH_LIMITS, MARKETS


def fk_valid(children: DataFrame, parents: DataFrame, key: str = "code") -> DataFrame:
    """Child rows whose key exists in the parent table (EXISTS)."""
    return children.join(parents.select(key), key, "left_semi")


def fk_orphans(children: DataFrame, parents: DataFrame, key: str = "code") -> DataFrame:
    """Child rows whose key is missing from the parent table (NOT EXISTS)."""
    return children.join(parents.select(key), key, "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") > 1))


def _long(tbl: str, wide: DataFrame) -> DataFrame:
    """Turn a one-row frame of counts into rows (tbl, check_name, n_bad)."""
    cols = wide.columns
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) as (check_name, n_bad)") \
               .select(F.lit(tbl).alias("tbl"), "check_name",
                       F.col("n_bad").cast("bigint").alias("n_bad"))


def table_report(tbl: str, df: DataFrame, keys: Sequence[str], not_null: Sequence[str] = (),
                 lengths: dict | None = None, domain: tuple | None = None,
                 parents: DataFrame | None = None, parent_key: str = "code") -> DataFrame:
    """Every check of one table in a single scan: duplicate keys, NULLs,
    length limits, a value domain and (with ``parents``) orphan keys.

    One partial aggregate per key carries all counts; with ``parents`` it is
    rolled up to one row per parent key and joined with the distinct parent
    keys, so the orphan check never joins the full table.
    """
    keys = list(keys)
    lengths = lengths or {}
    per_row = []   # counted per key group
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in not_null:
        if c not in keys:
            aggs.append(F.count_if(F.col(c).isNull()).alias(f"null_{c}"))
            per_row.append(f"null_{c}")
    for c, n in lengths.items():
        if c not in keys:
            aggs.append(F.count_if(F.length(c) > n).alias(f"len_{c}"))
            per_row.append(f"len_{c}")
    if domain:
        col, values = domain
        aggs.append(F.count_if(~F.col(col).isin(*values)).alias(f"domain_{col}"))
        per_row.append(f"domain_{col}")
    g = df.groupBy(*keys).agg(*aggs)

    dup = "dup_" + "_".join(keys)
    key_checks = {dup: (F.col("_n") > 1).cast("bigint")}
    for k in keys:
        if k in not_null:
            key_checks[f"null_{k}"] = F.when(F.col(k).isNull(), F.col("_n")).otherwise(0)
        if k in lengths:
            key_checks[f"len_{k}"] = F.when(F.length(k) > lengths[k], F.col("_n")).otherwise(0)
    g = g.select(*keys, "_n", *per_row, *[v.alias(k) for k, v in key_checks.items()])
    checks = [dup] + [f"null_{c}" for c in not_null] + [f"len_{c}" for c in lengths] + \
        ([f"domain_{domain[0]}"] if domain else [])

    if parents is not None:
        rolled = g.groupBy(parent_key).agg(*[F.sum(c).alias(c) for c in ["_n", *checks]])
        p = parents.select(parent_key).distinct().withColumn("_parent", F.lit(True))
        g = (rolled.join(p, parent_key, "left")
                   .withColumn("orphan_code", F.when(F.col("_parent").isNull(), F.col("_n")).otherwise(0)))
        checks.append("orphan_code")
    wide = g.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in checks])
    return _long(tbl, wide)


def quality_report(master: DataFrame, bars: DataFrame, features: DataFrame,
                   markets=MARKETS) -> DataFrame:
    """All integrity checks of the three tables, one scan per table."""
    rates = ["open_change_rate", "close_change_rate", "high_change_rate", "low_change_rate"]
    return reduce(DataFrame.unionByName, [
        table_report("master", master, ["code"], ["code", "name", "market_type"],
                     LENGTH_LIMITS, ("market_type", tuple(markets))),
        table_report("bars", bars, ["code", "date"],
                     ["code", "date", "open", "high", "low", "close", "volume"],
                     {"code": LENGTH_LIMITS["code"]}, parents=master),
        table_report("features", features, ["code", "date"], ["code", "date", *rates],
                     {"code": LENGTH_LIMITS["code"]}, parents=master),
    ])
