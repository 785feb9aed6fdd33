"""Fixed-width master files: text lines -> (code, name, market_type).

Survey rows: S1 S5 U2 P3 P8 P9 F12-F16 Q7 (D7 D13 D14 D15).

Line layout, 0-based half-open character positions after decoding:
``[0, 9)`` code, ``[21, len - tail)`` name, last ``tail`` characters ignored.
Lines are split on ``\\n`` only, so a trailing ``\\r`` counts towards the
length. Lines whose name range is empty, and lines with a blank code or
name, go to quarantine instead of being dropped silently.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybars.functions.parse import utrim

# Layout of a master line and the file charset.
CODE_WIDTH = 9
NAME_START = 21
TAIL_WIDTH = 228
CHARSET = "x-windows-949"


def read_master_text(spark: SparkSession, path: str, encoding: str = CHARSET) -> DataFrame:
    """Decoded lines of master files as ``DataFrame[line: string]``.

    The CSV reader is used because it honours ``encoding`` (the text source
    ignores it); a separator and quote that never occur keep each line in
    one column. Files split across tasks like any text input.
    """
    if encoding.lower() not in ("utf-8", "utf8"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return (spark.read
                 .option("encoding", encoding)
                 .option("sep", "\u0001")
                 .option("quote", "")
                 .option("escape", "")
                 .option("comment", "")
                 .option("lineSep", "\n")
                 .option("mode", "PERMISSIVE")
                 .schema("line string")
                 .csv(path))


def read_master_zip(spark: SparkSession, path: str, member: str | None = None,
                    encoding: str = "cp949", chunk_lines: int = 50_000) -> DataFrame:
    """Lines of master files packed in zip archives (one archive per row).

    Only the inflate step runs in Python (``mapInPandas`` over ``binaryFile``);
    each member is decoded as a stream and emitted in batches of
    ``chunk_lines`` lines, so memory stays bounded however large it is.
    Lines split on ``\\n`` only, keeping a trailing ``\\r``; empty lines are
    dropped, as the text reader does. With ``member`` only that entry is read,
    and an archive without it is an error.
    """
    raw = spark.read.format("binaryFile").load(path).select("content")

    def inflate(batches):
        import codecs
        import io
        import zipfile

        import pandas as pd
        for pdf in batches:
            for blob in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(blob))) as z:
                    if member and member not in z.namelist():
                        raise LookupError(f"no entry {member!r} in the archive, only {z.namelist()[:5]}")
                    names = [member] if member else [n for n in z.namelist() if not n.endswith("/")]
                    for n in names:
                        dec = codecs.getincrementaldecoder(encoding)(errors="replace")
                        out, rest = [], ""
                        with z.open(n) as f:
                            for block in iter(lambda: f.read(1 << 20), b""):
                                parts = (rest + dec.decode(block)).split("\n")
                                rest = parts.pop()
                                out.extend(x for x in parts if x)    # like the text reader
                                if len(out) >= chunk_lines:
                                    yield pd.DataFrame({"line": out}, dtype=object)
                                    out = []
                        rest += dec.decode(b"", final=True)
                        if rest:
                            out.append(rest)
                        yield pd.DataFrame({"line": out}, dtype=object)

    return raw.mapInPandas(inflate, "line string")


def split_master_lines(lines: DataFrame, market: str, tail: int = TAIL_WIDTH):
    """Parse lines of one market. Returns ``(rows, quarantine)``.

    rows: code, name, market_type. quarantine: QUARANTINE-shaped rows.
    """
    n = F.length("line")
    code = utrim(F.substring("line", 1, CODE_WIDTH))
    name_len = n - F.lit(tail + NAME_START)
    name = utrim(F.expr(f"substring(line, {NAME_START + 1}, greatest(length(line) - {tail + NAME_START}, 0))"))
    x = lines.where(F.col("line").isNotNull()).select(
        "line", code.alias("code"), name.alias("name"),
        F.when(name_len <= 0, F.lit("short line"))
         .when(code == "", F.lit("blank code"))
         .when(name == "", F.lit("blank name")).alias("reason"))
    rows = x.where(F.col("reason").isNull()).select(
        "code", "name", F.lit(market).alias("market_type"))
    bad = x.where(F.col("reason").isNotNull()).select(
        F.lit("master").alias("source"),
        F.when(F.col("code") != "", F.col("code")).alias("code"),
        F.lit(None).cast("string").alias("window_start"),
        F.lit(None).cast("string").alias("window_end"),
        F.concat(F.col("reason"), F.lit(f" ({market})")).alias("reason"),
        F.col("line").alias("raw"))
    return rows, bad


def parse_master_lines(lines: DataFrame, market: str, tail: int = TAIL_WIDTH) -> DataFrame:
    """Valid rows only (see :func:`split_master_lines`)."""
    return split_master_lines(lines, market, tail)[0]


def union_markets(frames: Iterable[DataFrame]) -> DataFrame:
    """Union of per-market master rows, in the given market order, with a
    ``_prio`` column (position) so that a code listed in several markets
    resolves to the last one deterministically."""
    frames = list(frames)
    tagged = [f.withColumn("_prio", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, tagged)


def read_masters(spark: SparkSession, paths: dict, tail: int | dict = TAIL_WIDTH,
                 encoding: str = CHARSET):
    """Read and parse several market files: ``{market: path}``. Returns
    ``(rows_with_prio, quarantine)``."""
    rows, bad = [], []
    for market, path in paths.items():
        t = tail[market] if isinstance(tail, dict) else tail
        r, q = split_master_lines(read_master_text(spark, path, encoding), market, t)
        rows.append(r)
        bad.append(q)
    return union_markets(rows), reduce(DataFrame.unionByName, bad)
