"""Name lookup: name -> code -> that code's bars, newest first.

Survey rows: J3 P4 P5 P11 O2 O4 C6 (D16).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from daybars.schemas import BAR_VALUES

# Fixed value: names compare without regard to case, accents and trailing
# spaces, as under the collation of the reference's tables.
NAME_COLLATION = "UNICODE_CI_AI_RTRIM"

# Codes in a block of the name index.
PER_BLOCK = 1_000


def check_name(name) -> str:
    if not isinstance(name, str) or not name.strip():
        raise ValueError(f"name must be a non-empty string, got {name!r}")
    return name


def find_code(master: DataFrame, name: str, case_sensitive: bool = False) -> DataFrame:
    """At most one master row with this name: the smallest code among equal
    names (deterministic first match)."""
    check_name(name)
    if case_sensitive:
        cond = F.col("name") == F.lit(name)          # pushed to the Parquet scan
    else:
        cond = F.collate(F.col("name"), NAME_COLLATION) == F.lit(name)
    return (master.where(cond)
                  .select("code", "name", "market_type")
                  .orderBy("code").limit(1))


def name_index(master: DataFrame, per_block: int = PER_BLOCK) -> DataFrame:
    """(name_key, code, name, market_type): the master in the order of the lookup
    collation, cut into blocks of ``per_block`` rows; ``name_key`` numbers the
    blocks in that order.

    A collated predicate reaches no Parquet file, an equality on the bigint block
    does. Which block a name is in, :func:`name_blocks` tells.
    """
    rows = master.select("code", "name", "market_type").orderBy(F.collate("name", NAME_COLLATION), "code")
    place = F.monotonically_increasing_id()         # the rank, with gaps between partitions
    first = F.shiftleft(F.shiftright(place, 33), 33)
    return rows.select((first + F.floor((place - first) / per_block)).alias("name_key"), "code", "name", "market_type")


def name_blocks(names: DataFrame) -> DataFrame:
    """(name_key, first, last): the least and greatest name of every block, one row
    for ``PER_BLOCK`` codes."""
    name = F.collate("name", NAME_COLLATION)
    return names.groupBy("name_key").agg(F.min(name).cast("string").alias("first"), F.max(name).cast("string").alias("last"))


def find_indexed(names: DataFrame, blocks: DataFrame, name: str, case_sensitive: bool = False) -> DataFrame:
    """:func:`find_code` by way of the name index: the blocks whose range holds
    the name (one, or as many as equal names fill), then their rows."""
    check_name(name)
    in_range = ((F.collate("first", NAME_COLLATION) <= F.lit(name)) & (F.collate("last", NAME_COLLATION) >= F.lit(name)))
    found = [r["name_key"] for r in blocks.where(in_range).select("name_key").collect()]
    return find_code(names.where(F.col("name_key").isin(*found) if found else F.lit(False)), name, case_sensitive)


def lookup_indexed(names: DataFrame, blocks: DataFrame, bars: DataFrame, name: str,
                   case_sensitive: bool = False) -> DataFrame:
    """:func:`lookup_bars` by way of the name index."""
    return _bars_of(find_indexed(names, blocks, name, case_sensitive).first(), bars, name)


def lookup_bars(master: DataFrame, bars: DataFrame, name: str,
                case_sensitive: bool = False) -> DataFrame:
    """All bars of the code named ``name``, newest first, with the master
    columns and ``rn`` (1 = newest). Raises ``LookupError`` when no code has
    that name.

    The master match is one row, fetched once; the bar scan then filters on
    a literal code, which Parquet push-down turns into row-group skipping.
    """
    return _bars_of(find_code(master, name, case_sensitive).first(), bars, name)


def _bars_of(hit: Row | None, bars: DataFrame, name: str) -> DataFrame:
    if hit is None:
        raise LookupError(f"no code named {name!r}")
    # One code: a row per day, some ten thousand in a lifetime.
    newest = Window.orderBy(F.col("date").desc())
    return (bars.where(F.col("code") == F.lit(hit["code"]))
                .select("code", F.lit(hit["name"]).alias("name"),
                        F.lit(hit["market_type"]).alias("market_type"),
                        "date", *BAR_VALUES,
                        F.row_number().over(newest).cast("bigint").alias("rn"))
                .orderBy(F.col("date").desc()))
