"""Lenient text conversions, all JVM-side built-ins (no Python UDF).

Survey rows: F3 F4 F10 F11 F13 (D1 D15).

ANSI mode is on, so a plain ``cast`` of bad text raises; every conversion
here goes through ``try_cast`` / ``try_to_date`` and never fails on data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The numeric prefixes a lenient parser accepts.
# A float prefix: optional sign, digits with an optional fraction (or a bare
# fraction), optional exponent; or Infinity. An integer prefix: sign + digits.
FLOAT_PREFIX = r"^[\s\p{Z}\x{FEFF}]*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))"
INT_PREFIX = r"^[\s\p{Z}\x{FEFF}]*([+-]?[0-9]+)"
# Whitespace stripped by a Unicode-aware trim: ASCII controls, every Unicode
# separator (Zs, Zl, Zp) and the byte-order mark.
UNICODE_SPACE = r"[\s\p{Z}\x{FEFF}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num_or_zero(x) -> Column:
    """Longest numeric prefix as double; no prefix, NaN or -0 give 0.0."""
    v = F.regexp_extract(_c(x), FLOAT_PREFIX, 1).try_cast("double")
    v = F.coalesce(v, F.lit(0.0))
    # A falsy result (0, -0, NaN) becomes +0.0.
    return F.when(F.isnan(v) | (v == 0.0), F.lit(0.0)).otherwise(v)


def int_or_zero(x) -> Column:
    """Leading base-10 integer as bigint; anything else gives 0."""
    v = F.regexp_extract(_c(x), INT_PREFIX, 1).try_cast("bigint")
    return F.coalesce(v, F.lit(0).cast("bigint"))


def utrim(x) -> Column:
    """Trim all Unicode whitespace (Spark's ``trim`` strips spaces only)."""
    return F.regexp_replace(_c(x), f"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")


def parse_yyyymmdd(x) -> Column:
    """``YYYYMMDD`` text to date; invalid text (e.g. month 13) gives NULL."""
    return F.try_to_date(_c(x), "yyyyMMdd")


def format_yyyymmdd(x) -> Column:
    """Date to zero-padded ``YYYYMMDD`` text."""
    return F.date_format(_c(x), "yyyyMMdd")
