"""Per-customer transaction history.

Input is D1 output (one row per customer and day).  Two forms give the same rows:

* ``transaction_history`` in one pass: each customer holds at most one row per calendar day,
  which bounds its window, and the ``lag`` window and the aggregate that follows share ONE
  hash exchange on ``msno``.
* ``merged_history`` of ``monthly_states``: a customer's months are worked on alone (windows of
  at most 31 rows), and one aggregate gives each month's boundary state (first and last
  price, changes, last row, cancellations, expiry), one row per payment method used in it.
  Neighbouring states merge: their changes add up, plus one if the prices at the border
  differ, and the methods are counted distinctly.  States can be kept and added to, and a
  customer's rows are dealt out by months.  All buffers are primitive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST_ROW_COLUMNS = ("plan_list_price", "payment_plan_days", "is_auto_renew", "payment_method_id",
                    "transaction_date")


def plan_change_flags(tx: DataFrame, key: str = "msno", date_col: str = "transaction_date",
                      price: str = "plan_list_price") -> DataFrame:
    """W1 helper over one date-ordered window per customer: ``_changed`` flags a
    row whose price differs from the previous row (a NULL on either side
    counts, the first row never does); ``_is_last`` marks the latest row (D2;
    a NULL date sorts last, so it counts as latest)."""
    w = Window.partitionBy(key).orderBy(F.col(date_col).asc_nulls_last())
    prev = F.lag(price).over(w)
    first = F.row_number().over(w) == 1
    same = F.coalesce(F.col(price) == prev, F.lit(False))
    last = F.lead(F.lit(1)).over(w).isNull()
    return tx.withColumns({"_changed": F.when(first | same, F.lit(0)).otherwise(F.lit(1)), "_is_last": last})


def transaction_history(tx: DataFrame, key: str = "msno") -> DataFrame:
    """Per customer: last-row fields (D2), plan changes (W1), distinct payment
    methods (A7), cancellations (A8) and max expiry (A9).  The aggregate reuses
    the window's partitioning (no second exchange) and has primitive buffers
    only, so it runs as a hash aggregate."""
    flagged = plan_change_flags(tx, key)
    last = F.col("_is_last")
    return (flagged.groupBy(key)
            .agg(*[F.max(F.when(last, F.col(c))).alias(f"last_{c}") for c in LAST_ROW_COLUMNS],
                 F.sum("_changed").cast("long").alias("num_plan_changes"),
                 F.count_distinct("payment_method_id").cast("long").alias("num_payment_methods"),
                 F.coalesce(F.sum("is_cancel"), F.lit(0)).cast("long").alias("num_cancellations"),
                 F.max("membership_expire_date").alias("max_expire_date")))


def _differs(now: Column, before: Column) -> Column:
    """A price change: unequal, or a NULL on either side."""
    return F.when(F.coalesce(now == before, F.lit(False)), F.lit(0)).otherwise(F.lit(1))


def monthly_states(tx: DataFrame, key: str = "msno", date_col: str = "transaction_date", price: str = "plan_list_price") -> DataFrame:
    """The boundary state of each customer's calendar month, a row per payment method in it (rows
    without a date are a month of their own, the latest).  The row of the month's first day
    has ``_head``.  States of new months can be added to a kept table."""
    month = F.trunc(F.col(date_col).cast("date"), "month")
    tx = tx.withColumn("_month", F.coalesce(month, F.lit("9999-12-01").cast("date")))
    w = Window.partitionBy(key, "_month").orderBy(F.col(date_col).asc_nulls_last())
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rn = F.row_number().over(w)
    flagged = tx.withColumns({"_changed": F.when(rn == 1, F.lit(0)).otherwise(_differs(F.col(price), F.lag(price).over(w))),
                              "_first": rn == 1, "_is_last": F.lead(F.lit(1)).over(w).isNull(),
                              "_first_price": F.first(price).over(whole), "_last_price": F.last(price).over(whole)})
    last = F.col("_is_last")
    return (flagged.groupBy(key, "_month", "payment_method_id")
            .agg(*[F.max(F.when(last, F.col(c))).alias(f"last_{c}") for c in LAST_ROW_COLUMNS],
                 F.max("_first").alias("_head"), F.max("_first_price").alias("_first_price"), F.max("_last_price").alias("_last_price"),
                 F.sum("_changed").alias("_changes"), F.sum("is_cancel").alias("_cancels"), F.max("membership_expire_date").alias("_expire")))


def merged_history(states: DataFrame, key: str = "msno") -> DataFrame:
    """Merge monthly states to the per-customer history."""
    w = Window.partitionBy(key).orderBy("_month", F.col("_head").desc())
    # A month's head row comes first in it, so the heads before it are those of earlier months.
    price = F.last(F.when(F.col("_head"), F.struct("_last_price")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    lined = states.withColumns({"_before": price, "_latest": F.max("_month").over(Window.partitionBy(key))})
    border = F.when(F.col("_head") & F.col("_before").isNotNull(), _differs(F.col("_first_price"), F.col("_before._last_price"))).otherwise(F.lit(0))
    latest = F.col("_month") == F.col("_latest")
    return (lined.groupBy(key)
            .agg(*[F.max(F.when(latest, F.col(f"last_{c}"))).alias(f"last_{c}") for c in LAST_ROW_COLUMNS],
                 F.sum(F.col("_changes") + border).cast("long").alias("num_plan_changes"),
                 F.count_distinct("payment_method_id").cast("long").alias("num_payment_methods"),
                 F.coalesce(F.sum("_cancels"), F.lit(0)).cast("long").alias("num_cancellations"),
                 F.max("_expire").alias("max_expire_date")))
