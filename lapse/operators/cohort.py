"""Segments and cohort statistics.

Each statistic is one global aggregate (partial per task, one-row final), or
for all segments at once a single ``cube`` pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.config import RiskThresholds


def tenure_bucket(tenure="days_since_registration", new_days: int = 30) -> Column:
    t = F.col(tenure) if isinstance(tenure, str) else tenure
    return F.when(t < F.lit(new_days), F.lit("new")).when(t >= F.lit(new_days), F.lit("old"))


def segment_filter(df: DataFrame, plan_type: int | None = None, tenure: str | None = None,
                   new_days: int = 30) -> DataFrame:
    """P5: optional plan-length equality AND optional tenure bucket; an
    unrecognised bucket applies no filter.  The -1 sentinel falls in 'new'."""
    if plan_type is not None:
        df = df.filter(F.col("payment_plan_days") == F.lit(int(plan_type)))
    if tenure == "new":
        df = df.filter(F.col("days_since_registration") < F.lit(new_days))
    elif tenure == "old":
        df = df.filter(F.col("days_since_registration") >= F.lit(new_days))
    return df


def _tier_aggs(t: RiskThresholds) -> list[Column]:
    p = F.col("churn_probability")
    high = p >= F.lit(t.high)
    med = (p >= F.lit(t.medium)) & (p < F.lit(t.high))
    low = p < F.lit(t.medium)
    return [
        F.count(F.lit(1)).alias("total_customers"),
        F.coalesce(F.avg(p), F.lit(0.0)).alias("churn_rate"),
        F.coalesce(F.avg(high.cast("double")), F.lit(0.0)).alias("high_share"),
        F.coalesce(F.avg(med.cast("double")), F.lit(0.0)).alias("medium_share"),
        F.coalesce(F.avg(low.cast("double")), F.lit(0.0)).alias("low_share"),
    ]


def tier_map() -> Column:
    return F.create_map(F.lit("High"), F.col("high_share"), F.lit("Medium"), F.col("medium_share"),
                        F.lit("Low"), F.col("low_share"))


def cohort_stats(df: DataFrame, plan_type: int | None = None, tenure: str | None = None,
                 t: RiskThresholds = RiskThresholds()) -> DataFrame:
    """N, mean p (as churn rate) and tier shares of a segment, as one row;
    an empty selection gives 0 everywhere.  ``risk_tier_distribution`` is the
    shares as a map."""
    out = segment_filter(df, plan_type, tenure).agg(*_tier_aggs(t))
    return out.withColumn("risk_tier_distribution", tier_map())


def segment_cube(df: DataFrame, t: RiskThresholds = RiskThresholds()) -> DataFrame:
    """Every (plan length x tenure bucket) segment and their roll-ups in one
    pass; ``grouping_id`` tells a roll-up NULL from a NULL bucket."""
    return (df.withColumn("tenure_bucket", tenure_bucket())
              .cube("payment_plan_days", "tenure_bucket")
              .agg(F.grouping_id().alias("grouping_id"), *_tier_aggs(t)))


def risk_distribution(df: DataFrame, t: RiskThresholds = RiskThresholds()) -> DataFrame:
    """Percent of the population in the High and Medium tiers."""
    p = F.col("churn_probability")
    return df.agg(
        F.count(F.lit(1)).alias("total_customers"),
        (F.avg((p >= F.lit(t.high)).cast("double")) * 100).alias("high_pct"),
        (F.avg(((p >= F.lit(t.medium)) & (p < F.lit(t.high))).cast("double")) * 100).alias("medium_pct"),
    )
