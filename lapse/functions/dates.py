"""Date helpers (F1, F2, F6) as Column expressions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_lit(d) -> Column:
    """A reference date as a DATE literal (accepts str 'yyyy-MM-dd' or date)."""
    if isinstance(d, _dt.datetime):
        d = d.date()
    if isinstance(d, _dt.date):
        d = d.isoformat()
    return F.lit(d).cast("date")


def parse_yyyymmdd(c) -> Column:
    """yyyyMMdd (int or text) -> DATE; anything unparseable -> NULL."""
    text = F.trim(as_col(c).cast("string"))
    return F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")


def iso_date_text(c) -> Column:
    """a date, or yyyyMMdd text of length 8, as ``yyyy-MM-dd`` text."""
    col = as_col(c)
    text = col.cast("string")
    return F.when(
        F.length(text) == 8,
        F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)),
    ).otherwise(text)
