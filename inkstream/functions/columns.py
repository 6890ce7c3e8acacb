"""Small column expressions used by several operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(as_of: str | datetime | Column | None) -> Column:
    """The reference instant of a time-relative operator (default: now)."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    text = as_of.isoformat(sep=" ") if isinstance(as_of, datetime) else as_of
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def pct(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``; NULL for an empty whole."""
    return F.try_divide(part * F.lit(100.0), whole)


def ago(as_of: Column, width: str) -> Column:
    return as_of - F.expr(f"INTERVAL {width}")


def as_bigint(col: Column) -> Column:
    return col.cast("bigint")


#: Characters ``strip`` removes at both ends.
BLANKS = " \t\n\r\x0b\x0c"


def strip(col: Column) -> Column:
    """Remove all surrounding white space, not only spaces."""
    return F.btrim(col, F.lit(BLANKS))
