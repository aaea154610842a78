"""Ranking, top-k and diversified top-N.

Ties are broken on ``msno`` everywhere, so results never depend on input
order.  Top-k is ``orderBy().limit()`` (planned as TakeOrderedAndProject: a
bounded heap per task, then a merge of k rows per task).  Per-stratum quotas
use ``row_number() <= q`` (planned with a partial WindowGroupLimit before the
shuffle).  Nothing here collects to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapse.config import BusinessConfig, DiversifyQuotas, RiskThresholds
from lapse.operators.cumulative import running_totals
from lapse.operators.value import estimated_clv, expected_value

EV = "expected_value"


def _ev_order():
    return [F.col(EV).desc_nulls_last(), F.col("msno").asc()]


def with_value(df: DataFrame, cfg: BusinessConfig = BusinessConfig()) -> DataFrame:
    """K1 helper: add CLV / EV only when those columns are absent."""
    if "estimated_clv" not in df.columns:
        df = df.withColumn("estimated_clv", estimated_clv(cfg))
    if EV not in df.columns:
        df = df.withColumn(EV, expected_value("churn_probability", "estimated_clv", cfg))
    return df


def prioritized_action_list(df: DataFrame, cfg: BusinessConfig = BusinessConfig()) -> DataFrame:
    """K1: customers ordered by expected value, highest first (a distributed
    range-partitioned sort; no global row numbering)."""
    return with_value(df, cfg).orderBy(*_ev_order())


def ranked(df: DataFrame) -> DataFrame:
    """``rank`` (1 = highest expected value, ties by ``msno``) without a one-partition
    window: exact running totals over the value order.  A NULL value ranks last."""
    floor = df.agg(F.min(EV).alias("low")).select(F.coalesce("low", F.lit(0.0)) - 1.0).scalar()
    keyed = df.withColumns({"_down": -F.coalesce(F.col(EV), floor), "_one": F.lit(1)})
    return running_totals(keyed, ["_down", "msno"], ["_one"]).withColumnRenamed("cum__one", "rank").drop("_down", "_one")


def reprice(df: DataFrame, base: BusinessConfig = BusinessConfig(), discount_cost=None,
            retention_rate=None) -> DataFrame:
    """K4: EV recomputed under overridden cost / success rate (pure: ``base`` is unchanged)."""
    if discount_cost is None and retention_rate is None:
        return df
    cfg = base.with_overrides(discount_cost, retention_rate)
    return df.withColumn(EV, expected_value("churn_probability", "estimated_clv", cfg))


def top_n(df: DataFrame, n: int = 10, max_n: int = 100) -> DataFrame:
    """K2: the n highest-EV customers (n <= max_n, checked before planning)."""
    if n < 1 or n > max_n:
        raise ValueError(f"top_n must be within 1..{max_n}")
    return df.orderBy(*_ev_order()).limit(n)


def diversified_top_n(df: DataFrame, n: int = 10, t: RiskThresholds = RiskThresholds(),
                      q: DiversifyQuotas = DiversifyQuotas(), max_n: int = 100) -> DataFrame:
    """K3: best-EV customers per stratum (High, Medium, new Low), then fillers.

    Strata: p >= high (quota 4); medium <= p < high (3); p < medium with tenure
    below ``low_new_max_tenure_days`` (3); the rest (0).  If fewer than ``n`` were picked, the
    best remaining customers fill up to ``n``; if the quotas exceed ``n`` the
    list is NOT truncated.  Result ordered by EV.

    One read: the picks and at most ``n`` fillers of a stratum are among its first quota + n
    rows, so a top-k per stratum (cut in every task before the shuffle) leaves at most
    4 * (max quota + n) rows, and both choices are made on those.
    """
    if n < 1 or n > max_n:
        raise ValueError(f"top_n must be within 1..{max_n}")
    p, tenure = F.col("churn_probability"), F.col("days_since_registration")
    quotas = (q.high, q.medium, q.low_new, 0)
    stratum = (F.when(p >= F.lit(t.high), F.lit(0))
                .when(p >= F.lit(t.medium), F.lit(1))
                .when(tenure < F.lit(q.low_new_max_tenure_days), F.lit(2)).otherwise(F.lit(3)))
    first = Window.partitionBy("_stratum").orderBy(*_ev_order())
    few = (df.withColumn("_stratum", stratum).withColumn("_rn", F.row_number().over(first))
             .filter(F.col("_rn") <= F.lit(max(quotas) + n)))
    picked = F.col("_rn") <= F.element_at(F.array(*map(F.lit, quotas)), F.col("_stratum") + 1)
    few = few.withColumn("_picked", picked)
    chosen = Window.orderBy(F.col("_picked").desc(), *_ev_order())       # over the few rows left
    few = few.withColumns({"_no": F.row_number().over(chosen)})
    return (few.filter(F.col("_picked") | (F.col("_no") <= F.lit(n)))
               .drop("_stratum", "_rn", "_picked", "_no").orderBy(*_ev_order()))
