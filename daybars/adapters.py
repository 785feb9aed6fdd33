"""Map the driver's tables onto the daybars model (test and bench scaffolding).

* master  <- customer: code = c_custkey as text, name = c_name,
  market_type = c_mktsegment
* bars    <- events: one bar per (user_id, day); open/close = first/last
  value by (ts, event_id), high/low = max/min value, volume = purchases
* bars    <- lineitem (bench): one bar per (l_suppkey, ship day) on
  l_extendedprice, volume = total quantity
* quote records and fixed-width lines are rendered from those frames so that
  the parsers can be checked by round trip.

Every adapter is one partial aggregate or projection; nothing is collected.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybars.functions.parse import format_yyyymmdd
from daybars.schemas import QUOTE
from daybars.sources.master_text import CODE_WIDTH, NAME_START, TAIL_WIDTH

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ts_ntz(s: str):
    """A timestamp literal comparable with the driver's TIMESTAMP_NTZ columns."""
    return F.lit(s).cast("timestamp_ntz")


def master_from_customer(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").cast("string").alias("code"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("market_type"))


def bars_from_events(events: DataFrame) -> DataFrame:
    order = F.struct("ts", "event_id")
    return (events.groupBy(F.col("user_id").cast("string").alias("code"),
                           F.to_date("ts").alias("date"))
                  .agg(F.min_by("value", order).alias("open"),
                       F.max("value").alias("high"),
                       F.min("value").alias("low"),
                       F.max_by("value", order).alias("close"),
                       F.count_if(F.col("event_type") == "purchase").alias("volume")))


def bars_from_lineitem(lineitem: DataFrame) -> DataFrame:
    order = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
    return (lineitem.groupBy(F.col("l_suppkey").cast("string").alias("code"),
                             F.to_date("l_shipdate").alias("date"))
                    .agg(F.min_by("l_extendedprice", order).alias("open"),
                         F.max("l_extendedprice").alias("high"),
                         F.min("l_extendedprice").alias("low"),
                         F.max_by("l_extendedprice", order).alias("close"),
                         F.sum("l_quantity").cast("bigint").alias("volume")))


def quote_records(bars: DataFrame, end, fetch_seq: int = 0, window_days: int = 100) -> DataFrame:
    """Render bars as landed quote responses: one record per (code, window),
    windows of ``window_days`` counted back from ``end``. Each group holds at
    most ``window_days`` bars. Returns a frame with the QUOTE schema."""
    end = _dt.date.fromisoformat(end) if isinstance(end, str) else end
    i = F.floor(F.datediff(F.lit(end), F.col("date")) / F.lit(window_days)).cast("int")
    el = F.struct(
        format_yyyymmdd("date").alias("stck_bsop_date"),
        F.col("open").cast("string").alias("stck_oprc"),
        F.col("high").cast("string").alias("stck_hgpr"),
        F.col("low").cast("string").alias("stck_lwpr"),
        F.col("close").cast("string").alias("stck_clpr"),
        F.col("volume").cast("string").alias("acml_vol"))
    g = (bars.select("code", i.alias("i"), el.alias("e"))
             .groupBy("code", "i")
             .agg(F.array_sort(F.collect_list("e")).alias("output2")))
    seg_end = F.date_sub(F.lit(end), F.col("i") * window_days)
    return g.select(
        "code",
        format_yyyymmdd(F.date_sub(seg_end, window_days - 1)).alias("window_start"),
        format_yyyymmdd(seg_end).alias("window_end"),
        (F.lit(fetch_seq).cast("bigint") * 1000 + F.col("i")).alias("fetch_seq"),
        F.lit("0").alias("rt_cd"), F.lit("OK").alias("msg1"), "output2")


def quote_json_lines(records: DataFrame) -> DataFrame:
    """QUOTE records as JSON text (``value``), the landed file format."""
    return records.select(F.to_json(F.struct(*QUOTE.fieldNames())).alias("value"))


def from_json_lines(lines: DataFrame) -> DataFrame:
    """JSON text back to QUOTE records (``from_json`` with a fixed schema)."""
    return lines.select(F.from_json("value", QUOTE).alias("r")).select("r.*")


def master_lines(master: DataFrame, tail: int = TAIL_WIDTH, keep=()) -> DataFrame:
    """Render master rows as fixed-width lines: code padded to 9, a 12-char
    standard code, the name padded to 40, then ``tail`` filler characters.
    ``keep`` names extra columns to carry along."""
    std = F.concat(F.lit("KR"), F.lpad(F.col("code"), NAME_START - CODE_WIDTH - 2, "0"))
    name = F.concat(F.col("name"), F.repeat(F.lit(" "), F.greatest(F.lit(40) - F.length("name"), F.lit(0))))
    filler = F.rpad(F.concat(F.lit("ST"), F.col("code")), tail, "0")
    return master.select(
        F.concat(F.rpad(F.col("code"), CODE_WIDTH, " "), std, name, filler).alias("line"),
        "market_type", *keep)
