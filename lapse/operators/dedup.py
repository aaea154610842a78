"""Same-day dedup.

D1 partitions by (customer, day), not by customer: a customer holding a third
of all rows is spread over its days, and Spark plans a partial
``WindowGroupLimit`` before the shuffle, so repeated rows of one hot day are
cut map-side.  After D1 a customer has at most one row per calendar day, which
bounds every later per-customer window by the length of the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _desc_nulls_win(name: str) -> list[Column]:
    # Ascending sort + keep-last with NULL sorted last means NULL wins;
    # descending with nulls first gives the same winner at position 1.
    return [F.col(name).desc_nulls_first()]


def dedup_same_day(df: DataFrame, key: str = "msno", day: str = "transaction_date",
                   priority: tuple[str, ...] = ("is_cancel", "plan_list_price"),
                   seq_col: str | None = None) -> DataFrame:
    """One row per (key, day): highest ``priority`` columns win, NULL highest.

    Remaining ties are broken by ``seq_col`` descending when given, otherwise
    by every other column, so the result never depends on input order.
    """
    order: list[Column] = []
    for c in priority:
        order += _desc_nulls_win(c)
    if seq_col is not None:
        order.append(F.col(seq_col).desc_nulls_first())
    else:
        rest = [c for c in df.columns if c not in (key, day, *priority)]
        order += [F.col(c).desc_nulls_first() for c in rest]
    w = Window.partitionBy(key, day).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
