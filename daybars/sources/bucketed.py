"""Bar history bucketed by code, for rebuilds without a shuffle.

Survey rows: W1 W2 S4 C5.

A catalog table partitioned by month and bucketed by code: a bucket holds the
same codes in every month, so Spark knows that all bars of a code come
from one bucket and runs the LAG window over a scan without an exchange. The one
shuffle, by code, is paid when a month is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybars.operators.features import features_full
from daybars.schemas import BARS, FEATURES
from daybars.sources.tables import read_months, stored_months, write_months

#: A rebuild has as many tasks as buckets; choose bytes of history / 256 MB.
BUCKETS = 64


def open_bucketed(spark: SparkSession, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Make the table at ``path`` known to the catalog as ``table``, with the
    months that are stored there. The number of buckets must be that of its files."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in BARS.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}, month string) USING parquet PARTITIONED BY (month) "
              f"CLUSTERED BY (code) SORTED BY (code, date) INTO {buckets} BUCKETS LOCATION '{path}'")
    if stored_months(spark, path):
        spark.sql(f"MSCK REPAIR TABLE {table}")


def store_bucketed(bars: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    """``bars`` become the whole content of their months; other months stay.
    One file a month and bucket."""
    spark = bars.sparkSession
    rows = bars.select(*BARS.fieldNames(), F.date_format("date", "yyyy-MM").alias("month"))
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows.repartition(buckets, "code").sortWithinPartitions("month", "code", "date").write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, before)


def sync_bucketed(spark: SparkSession, bars_root: str, table: str, months=None, buckets: int = BUCKETS) -> None:
    """Copy ``months`` (default: all) of the stored bars into the bucketed table."""
    store_bucketed(read_months(spark, bars_root, BARS, months), table, buckets)


def rebuild_bucketed(spark: SparkSession, table: str, features_root: str) -> None:
    """C5 from the bucketed history: nothing is shuffled before the write."""
    months = {r["month"] for r in spark.sql(f"SELECT DISTINCT month FROM {table}").collect()}
    fresh = features_full(spark.table(table)).select(*FEATURES.fieldNames())
    write_months(fresh, features_root, months | set(stored_months(spark, features_root)), sort_by=["code", "date"], cluster=False)
