"""Percent change, the one arithmetic rule of the feature table.

Survey rows: F1 F2 (D2 D3).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct_change(cur, prev) -> Column:
    """((cur - prev) / NULLIF(prev, 0)) * 100, in double.

    ``nullif`` keeps ANSI division from raising when the previous value is 0;
    the result is then NULL. Integral inputs divide as double.
    """
    cur = F.col(cur) if isinstance(cur, str) else cur
    prev = F.col(prev) if isinstance(prev, str) else prev
    return ((cur - prev) / F.nullif(prev, F.lit(0))) * F.lit(100)
