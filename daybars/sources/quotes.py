"""Landed quote responses: JSON -> bars + quarantine.

Survey rows: S2 U1 P2 P3 P10 F3 F10 F11 F19 F20 F21 Q7 (D1 D17).

A landed record is one response plus its request parameters (see
``schemas.QUOTE``). Nothing is lost: every element of every response becomes
a bar or a quarantine row, and so does every response without elements that
is not a plain "no bars" answer. Quarantined are text that is not JSON (with
that text), responses with a status other than ``"0"`` (whole), and elements
without a code or with a missing or invalid date (alone; the rest of their
window is kept). Numbers parse leniently (bad text -> 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybars.functions.parse import int_or_zero, num_or_zero, parse_yyyymmdd
from daybars.schemas import QUOTE

CORRUPT = "_corrupt_record"
_RAW = T.StructType([*QUOTE.fields, T.StructField(CORRUPT, T.StringType())])
_BARS = ["open", "high", "low", "close", "volume"]


def read_quotes(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Landed responses with an arrival column ``_arrival`` taken from the
    file's modification time. Default: JSON lines (one response per line,
    files split across tasks); ``multiline``: one (pretty-printed) response
    document per file, as an API returns it. Text that is not JSON arrives
    in ``_corrupt_record``."""
    return _with_arrival(_options(spark.read, multiline).json(path))


def quote_stream(spark: SparkSession, landing: str, max_files: int | None = None,
                 multiline: bool = False) -> DataFrame:
    """:func:`read_quotes` as a stream of new files."""
    r = _options(spark.readStream, multiline)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return _with_arrival(r.json(landing))


def _options(reader, multiline: bool):
    return (reader.schema(_RAW).option("columnNameOfCorruptRecord", CORRUPT)
                  .option("multiLine", str(multiline).lower()))


def _with_arrival(raw: DataFrame) -> DataFrame:
    return (raw.withColumn("_arrival", F.col("_metadata.file_modification_time"))
               .withColumn("_file", F.col("_metadata.file_path")))


def parse_responses(raw: DataFrame) -> DataFrame:
    """One row per element of every response (one for a response without
    elements): the request, ``reason`` (NULL: good), ``raw``, the bar's fields
    (``date`` NULL where there is no bar) and ``seq``.

    ``seq`` orders elements by arrival: file time, file, fetch order, position
    in the array (later wins).
    """
    have = set(raw.columns)
    r = raw.select(
        "code", "window_start", "window_end", "fetch_seq", "rt_cd", "msg1", "output2",
        *[(F.col(c) if c in have else F.lit(None).cast(kind)).alias(c)
          for c, kind in ((CORRUPT, "string"), ("_arrival", "timestamp"), ("_file", "string"))])
    whole = F.to_json(F.struct(*QUOTE.fieldNames()))
    ok = F.coalesce("rt_cd", F.lit("")) == "0"
    refused = (F.when(F.col(CORRUPT).isNotNull(), "bad json")
                .when(~ok, F.concat(F.lit("rejected: "), F.coalesce("msg1", F.lit("")))))
    elements = F.when(refused.isNull(), F.col("output2"))
    x = r.select("code", "window_start", "window_end", F.coalesce("fetch_seq", F.lit(0)).alias("fetch_seq"),
                 refused.alias("refused"), F.coalesce(F.col(CORRUPT), F.when(refused.isNotNull(), whole)).alias("refused_raw"),
                 "_arrival", "_file", F.when(F.col("code").isNull() & refused.isNull(), whole).alias("response"),
                 F.posexplode_outer(elements).alias("pos", "e"))
    date = parse_yyyymmdd(F.col("e.stck_bsop_date"))
    reason = (F.coalesce("refused", F.when(F.col("code").isNull(), "no code")
                         .when(F.col("e").isNotNull() & date.isNull(), "bad date")
                         .when(F.col("e").isNull() & F.col("pos").isNotNull(), "bad date")))
    raw_text = F.coalesce("refused_raw", F.to_json("e"), F.col("response"))
    order = F.struct(F.col("_arrival").alias("arrival"), F.col("_file").alias("file"), F.col("fetch_seq").alias("fetch_seq"),
                     F.coalesce("pos", F.lit(-1)).alias("pos"))
    return x.select(
        "code", "window_start", "window_end", reason.alias("reason"),
        F.when(reason.isNotNull(), raw_text).alias("raw"),
        F.when(reason.isNull(), date).alias("date"),
        num_or_zero("e.stck_oprc").alias("open"), num_or_zero("e.stck_hgpr").alias("high"),
        num_or_zero("e.stck_lwpr").alias("low"), num_or_zero("e.stck_clpr").alias("close"),
        int_or_zero("e.acml_vol").alias("volume"), order.alias("seq"))


def bars_of(parsed: DataFrame) -> DataFrame:
    """code, date, values and ``seq`` of the good elements."""
    return parsed.where(F.col("reason").isNull() & F.col("date").isNotNull()).select("code", "date", *_BARS, "seq")


def quarantine_of(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select(
        F.lit("quote").alias("source"), "code", "window_start", "window_end", "reason", "raw")


def answers_of(parsed: DataFrame) -> DataFrame:
    """The last answer of every (code, window): ``rejected`` and ``n_bars``,
    the bars that could be read (a window of bad dates has none)."""
    one = F.col("response") if "response" in parsed.columns else F.struct("seq.arrival", "seq.file", "seq.fetch_seq")
    refused = F.col("reason").isNotNull() & F.col("reason").startswith("rejected")
    per = (parsed.where("code IS NOT NULL").groupBy("code", "window_start", "window_end", one.alias("response"))
                 .agg(F.bool_or(refused).alias("rejected"),
                      F.count_if(F.col("reason").isNull() & F.col("date").isNotNull()).alias("n_bars")))
    last = per.groupBy("code", "window_start", "window_end").agg(
        F.max(F.struct("response", "rejected", "n_bars")).alias("last"))
    return last.select("code", parse_yyyymmdd(F.col("window_start")).alias("seg_start"),
                       parse_yyyymmdd(F.col("window_end")).alias("seg_end"), "last.rejected", "last.n_bars")


def split_quotes(raw: DataFrame):
    """``(bars with seq, quarantine)`` of responses. Callers that need both
    stage :func:`parse_responses` first, so that the JSON is read once."""
    parsed = parse_responses(raw)
    return bars_of(parsed), quarantine_of(parsed)


def parse_quotes(raw: DataFrame) -> DataFrame:
    """Bars (with ``seq``) only; see :func:`split_quotes`."""
    return bars_of(parse_responses(raw))


def ranked(parsed: DataFrame) -> DataFrame:
    """:func:`parse_responses` with ``seq`` as one bigint of the same order, so
    that keep-last is a hash aggregate and no path is shuffled with a row.

    From the top: rank of the file by (time, path), fetch order, position in the
    array, each as wide as the data at hand need. Pass staged elements; they
    are read once more for the widths. The files (one row each) are ranked apart and joined
    back by size. Where the widths exceed 62 bits ``seq`` stays as it is.
    """
    arrival = F.coalesce(F.col("seq.arrival"), F.lit(0).cast("timestamp"))
    file = F.coalesce(F.col("seq.file"), F.lit(""))
    files = parsed.select(arrival.alias("_t"), file.alias("_f")).distinct()
    widest = parsed.agg(F.min("seq.fetch_seq").alias("low"), F.max("seq.fetch_seq").alias("high"),
                        F.max("seq.pos").alias("pos")).first()
    if widest["low"] is None:
        return parsed.withColumns({"seq": F.lit(0).cast("bigint"), "response": F.lit(0).cast("bigint")})
    pos_bits = (widest["pos"] + 1).bit_length()
    low_bits = pos_bits + (widest["high"] - widest["low"]).bit_length()
    # written, so that its size is known and it is broadcast while small
    numbered = _written(files.withColumn("_rank", F.row_number().over(Window.orderBy("_t", "_f")).cast("bigint")), "files")
    if low_bits + numbered.count().bit_length() > 62:
        return parsed
    packed = (F.shiftleft("_rank", low_bits) + F.shiftleft(F.col("seq.fetch_seq") - F.lit(widest["low"]), pos_bits)
              + F.col("seq.pos") + 1)
    joined = parsed.withColumns({"_t": arrival, "_f": file}).join(numbered, ["_t", "_f"])
    return joined.select(*[c for c in parsed.columns if c != "seq"], packed.alias("seq"),
                         F.shiftright(packed, pos_bits).alias("response"))


def stage(parsed: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Parsed elements as Parquet in the shared folder: the landing is read
    once, later steps prune columns and skip row groups. ``spark`` is the
    session that reads them (a streamed batch has one of its own)."""
    return _written(parsed, "landing", spark)


def _written(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    from daybars.session import scratch_dir

    spark = spark or df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
