"""Fixed schemas of the stored tables and raw inputs (never inferred)."""

from pyspark.sql import types as T

# master: one row per code
MASTER = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("market_type", T.StringType(), False),
    # naive wall-clock timestamps, like the source's DATETIME columns
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("updated_at", T.TimestampNTZType(), True),
])

# name index: one row per code in the order of the lookup collation, name_key
# numbers its blocks; NAME_BLOCKS has the range of names of each
NAMES = T.StructType([
    T.StructField("name_key", T.LongType(), True),
    T.StructField("code", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("market_type", T.StringType(), True),
])

NAME_BLOCKS = T.StructType([
    T.StructField("name_key", T.LongType(), True),
    T.StructField("first", T.StringType(), True),
    T.StructField("last", T.StringType(), True),
])

# bars: one row per (code, date)
BARS = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("open", T.DoubleType(), False),
    T.StructField("high", T.DoubleType(), False),
    T.StructField("low", T.DoubleType(), False),
    T.StructField("close", T.DoubleType(), False),
    T.StructField("volume", T.LongType(), False),
])
BAR_VALUES = ["open", "close", "high", "low", "volume"]

# features: one row per (code, date); every rate may be NULL (previous value 0)
FEATURES = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("open_change_rate", T.DoubleType(), True),
    T.StructField("close_change_rate", T.DoubleType(), True),
    T.StructField("high_change_rate", T.DoubleType(), True),
    T.StructField("low_change_rate", T.DoubleType(), True),
    T.StructField("volume_change_rate", T.DoubleType(), True),
])
RATE_COLUMNS = [f"{c}_change_rate" for c in BAR_VALUES]

# Field names of the quote response (status, message, bar
# array and the six bar fields), as the source API returns them.
# One element of a quote response's output2 array; every field is text.
QUOTE_ELEMENT = T.StructType([
    T.StructField("stck_bsop_date", T.StringType(), True),
    T.StructField("stck_oprc", T.StringType(), True),
    T.StructField("stck_hgpr", T.StringType(), True),
    T.StructField("stck_lwpr", T.StringType(), True),
    T.StructField("stck_clpr", T.StringType(), True),
    T.StructField("acml_vol", T.StringType(), True),
])

# a landed quote response: request parameters + response body
QUOTE = T.StructType([
    T.StructField("code", T.StringType(), True),
    T.StructField("window_start", T.StringType(), True),
    T.StructField("window_end", T.StringType(), True),
    T.StructField("fetch_seq", T.LongType(), True),
    T.StructField("rt_cd", T.StringType(), True),
    T.StructField("msg1", T.StringType(), True),
    T.StructField("output2", T.ArrayType(QUOTE_ELEMENT), True),
])

PLAN = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("mode", T.StringType(), False),
    T.StructField("i", T.IntegerType(), False),
    T.StructField("seg_start", T.DateType(), False),
    T.StructField("seg_end", T.DateType(), False),
])

# coverage: the last outcome of every window that was ever asked for
COVERAGE = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("seg_start", T.DateType(), False),
    T.StructField("seg_end", T.DateType(), False),
    T.StructField("answered", T.BooleanType(), False),
    T.StructField("n_bars", T.LongType(), False),
])

QUARANTINE = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("code", T.StringType(), True),
    T.StructField("window_start", T.StringType(), True),
    T.StructField("window_end", T.StringType(), True),
    T.StructField("reason", T.StringType(), False),
    T.StructField("raw", T.StringType(), True),
])

# The two markets of the reference and their column limits.
MARKETS = ("KOSPI", "KOSDAQ")
LENGTH_LIMITS = {"code": 10, "name": 100, "market_type": 10}
