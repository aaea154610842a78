"""Renewal-gap churn labels (L1, J12) and class balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.functions.dates import date_lit
from lapse.operators.asof import carried

PRIORITY = ("is_cancel", "plan_list_price")      # D1's order within a day


def label_churn(tx: DataFrame, cutoff, gap_days: int = 30, key: str = "msno", seq_col: str | None = None) -> DataFrame:
    """L1: churn label at a cutoff from raw transactions (several a day are fine).

    * last expiry = expiry of the row that same-day dedup (D1) keeps of the
      latest day on or before the cutoff (a cancellation carries its own, earlier,
      expiry);
    * next renewal = earliest non-cancel transaction after the cutoff, taken over
      all rows: a cancel followed by a renewal on one day is a renewal, though D1
      would keep the cancel;
    * churn = 1 when there is no renewal or ``renewal - expiry >= gap_days``;
      an early renewal (negative gap) is retained.

    One ``groupBy`` over one scan: it combines map-side, so a hot customer costs
    one row per map task in the shuffle.  D1's choice is the greatest struct of day
    and D1's order.  Customers with no transaction on or before the cutoff get no label.
    """
    c = date_lit(cutoff)
    d = F.col("transaction_date")
    before = d <= c
    rank = _rank(key, _ties(tx, key, seq_col))
    per = (tx.filter(d.isNotNull())
             .groupBy(key)
             .agg(F.max(F.when(before, d)).alias("_last_date"),
                  F.max_by(F.col("membership_expire_date"), F.when(before, rank)).alias("last_expire_date"),
                  F.min(F.when((d > c) & (F.col("is_cancel") == 0), d)).alias("next_renewal_date"))
             .filter(F.col("_last_date").isNotNull()))
    last_expire = F.col("last_expire_date")
    gap = F.datediff(F.col("next_renewal_date"), last_expire)
    churn = F.when(F.col("next_renewal_date").isNull() | gap.isNull() | (gap >= F.lit(gap_days)), F.lit(1)).otherwise(F.lit(0))
    return per.select(key, last_expire.alias("last_expire_date"), "next_renewal_date",
                      gap.alias("renewal_gap_days"), churn.cast("int").alias("is_churn"))


def _rank(key: str, ties: list[str]) -> Column:
    """D1's order of a customer's rows, the day first, as one comparable value."""
    return F.struct(F.col("transaction_date").alias("_d"), *(part for i, x in enumerate((*PRIORITY, *ties))
                    for part in (F.col(x).isNull().alias(f"_n{i}"), F.col(x).alias(f"_v{i}"))))


def _ties(tx: DataFrame, key: str, seq_col: str | None) -> list[str]:
    return [seq_col] if seq_col else [x for x in tx.columns if x not in (key, "transaction_date", *PRIORITY)]


def _labelled(df: DataFrame, gap_days: int) -> DataFrame:
    """L1's rule on (..., last_expire_date, next_renewal_date)."""
    gap = F.datediff("next_renewal_date", "last_expire_date")
    churn = gap.isNull() | (gap >= F.lit(gap_days))
    return df.withColumns({"renewal_gap_days": gap, "is_churn": churn.cast("int")})


def label_churn_at_all(tx: DataFrame, cutoffs: list, gap_days: int = 30, key: str = "msno", seq_col: str | None = None) -> DataFrame:
    """L1 at many cutoffs from one scan: (key, cutoff_date, last_expire_date, next_renewal_date,
    renewal_gap_days, is_churn), equal to :func:`label_churn` at each.

    The cutoffs cut time into intervals.  One aggregate keeps, per customer and interval, the
    last row's expiry and the first renewal (it combines map-side, so a hot customer is a
    row per task and interval); a window over a customer's at most len(cutoffs) + 1
    intervals finds the first renewal of the later ones, and each interval answers the cutoffs
    up to the customer's next one."""
    dates = sorted({str(c) for c in cutoffs})
    if not dates:
        raise ValueError("no cutoffs")
    lits = F.array(*(date_lit(c) for c in dates))
    d = F.col("transaction_date")
    interval = F.size(F.filter(lits, lambda c: c < d))
    per = (tx.filter(d.isNotNull()).groupBy(key, interval.alias("_i"))
           .agg(F.max_by("membership_expire_date", _rank(key, _ties(tx, key, seq_col))).alias("last_expire_date"),
                F.min(F.when(F.col("is_cancel") == 0, d)).alias("_renewal")))
    line = Window.partitionBy(key).orderBy("_i")
    later = line.rowsBetween(1, Window.unboundedFollowing)
    per = per.select(key, "_i", "last_expire_date", F.first("_renewal", ignorenulls=True).over(later).alias("next_renewal_date"),
                     F.coalesce(F.lead("_i").over(line), F.lit(len(dates))).alias("_next"))
    per = per.filter(F.col("_i") < F.lit(len(dates)))
    at = per.withColumn("_at", F.explode(F.sequence("_i", F.col("_next") - 1)))
    out = at.select(key, F.element_at(lits, F.col("_at") + 1).alias("cutoff_date"), "last_expire_date", "next_renewal_date")
    return _labelled(out, gap_days)


def label_churn_asof(tx: DataFrame, cutoffs: DataFrame, gap_days: int = 30, key: str = "msno", cutoff_col: str = "cutoff_date",
                     seq_col: str | None = None) -> DataFrame:
    """L1 where each customer has cutoffs of their own: a table (key, cutoff_date).

    Transactions are reduced to one row per customer and day (D1's row's expiry, and whether
    the day holds a renewal), then joined as of each cutoff in both directions at once: last
    expiry at or before it, first renewal after it.  Customers without a transaction on or
    before a cutoff get no label for it; repeated cutoffs are labelled once."""
    d = F.col("transaction_date")
    days = (tx.filter(d.isNotNull() & F.col(key).isNotNull()).groupBy(key, d.alias("_at"))
            .agg(F.struct(F.max_by("membership_expire_date", _rank(key, _ties(tx, key, seq_col))).alias("expire")).alias("_last"),
                 F.max(F.when(F.col("is_cancel") == 0, d)).alias("_renewal")))
    asked = cutoffs.select(key, F.col(cutoff_col).cast("date").alias("_at")).where(F.col(key).isNotNull() & F.col("_at").isNotNull()).distinct()
    union = (days.withColumn("_tag", F.lit(0)).unionByName(asked.withColumn("_tag", F.lit(1)), allowMissingColumns=True)
             .withColumn("_month", F.trunc("_at", "month")))
    lined = carried(union, key, ["_at", "_tag"], "_month", ["_last"], ["_renewal"])
    out = (lined.where("_tag = 1 and before__last is not null")
           .select(key, F.col("_at").alias(cutoff_col), F.col("before__last.expire").alias("last_expire_date"),
                   F.col("after__renewal").alias("next_renewal_date")))
    return _labelled(out, gap_days)


def agreed_labels(labels: DataFrame, key: str = "msno", label: str = "is_churn") -> DataFrame:
    """One label per customer; rows that contradict each other stop the job."""
    per = labels.groupBy(key).agg(F.min(label).alias("_low"), F.max(label).alias("_high"),
                                  (F.count(F.lit(1)) - F.count(label)).alias("_unknown"))
    clash = (F.col("_low") != F.col("_high")) | ((F.col("_unknown") > 0) & F.col("_low").isNotNull())
    text = F.concat(F.lit(f"conflicting {label} for {key} "), F.col(key).cast("string"))
    return per.select(key, F.when(clash, F.raise_error(text).cast("int")).otherwise(F.col("_low")).alias(label))


def class_balance(labels: DataFrame, label: str = "is_churn") -> DataFrame:
    """Counts, positive share, neg/pos ratio (1.0 when no positives)."""
    pos = F.sum(F.col(label)).cast("long")
    n = F.count(F.lit(1))
    return labels.agg(n.alias("n"), pos.alias("n_pos")).select(
        "n", "n_pos", (F.col("n") - F.col("n_pos")).alias("n_neg"),
        F.try_divide(F.col("n_pos"), F.col("n")).alias("positive_rate"),
        F.coalesce(F.try_divide((F.col("n") - F.col("n_pos")).cast("double"), F.col("n_pos")),
                   F.lit(1.0)).alias("scale_pos_weight"))
