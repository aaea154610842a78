"""Risk tier, confidence and customer-value operators.

All are Column expressions over the whole scored table (no per-row Python).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.config import BusinessConfig, RiskThresholds, ServeConfig
from lapse.functions.dates import as_col


def risk_tier(p="churn_probability", t: RiskThresholds = RiskThresholds()) -> Column:
    """P >= high -> 'High'; p >= medium -> 'Medium'; else 'Low' (inclusive lower bounds)."""
    p = as_col(p)
    return (F.when(p >= F.lit(t.high), F.lit("High"))
             .when(p >= F.lit(t.medium), F.lit("Medium"))
             .otherwise(F.lit("Low")))


def low_confidence(tenure="days_since_registration", min_days: int = ServeConfig().low_confidence_threshold_days) -> Column:
    """Tenure NULL or below the threshold (the -1 sentinel counts as low)."""
    t = as_col(tenure)
    return t.isNull() | (t < F.lit(min_days))


def estimated_clv(cfg: BusinessConfig = BusinessConfig(), price="plan_list_price",
                  plan_days="payment_plan_days") -> Column:
    """B1: monthly revenue (price normalised to 30 days) times lifespan; a NULL
    price or plan length, or a plan length <= 0, uses the default revenue."""
    price, days = as_col(price), as_col(plan_days)
    fallback = price.isNull() | days.isNull() | (days <= 0)
    monthly = F.when(fallback, F.lit(float(cfg.default_monthly_revenue))).otherwise(
        price * (F.lit(30.0) / days))
    return monthly * F.lit(float(cfg.avg_customer_lifespan_months))


def estimated_clv_flat(df: DataFrame, cfg: BusinessConfig = BusinessConfig()) -> Column:
    """Bulk form: amount paid times lifespan when that column exists,
    otherwise the default revenue for everyone."""
    life = F.lit(float(cfg.avg_customer_lifespan_months))
    if "actual_amount_paid" in df.columns:
        return F.col("actual_amount_paid").cast("double") * life
    return F.lit(float(cfg.default_monthly_revenue)) * life


def expected_value(p="churn_probability", clv="estimated_clv", cfg: BusinessConfig = BusinessConfig()) -> Column:
    """B2: p * success * clv - cost * clv (can be negative)."""
    p, clv = as_col(p), as_col(clv)
    return p * F.lit(float(cfg.retention_success_rate)) * clv - F.lit(float(cfg.discount_cost_percentage)) * clv


def score_customers(df: DataFrame, business: BusinessConfig = BusinessConfig(),
                    thresholds: RiskThresholds = RiskThresholds(), serve: ServeConfig = ServeConfig(),
                    clv_mode: str = "plan") -> DataFrame:
    """Add tier, CLV, EV and low-confidence to a table carrying ``churn_probability``."""
    clv = estimated_clv(business) if clv_mode == "plan" else estimated_clv_flat(df, business)
    out = df.withColumns({
        "risk_tier": risk_tier("churn_probability", thresholds),
        "estimated_clv": clv,
        "low_confidence": low_confidence("days_since_registration", serve.low_confidence_threshold_days),
    })
    return out.withColumn("expected_value", expected_value("churn_probability", "estimated_clv", business))
