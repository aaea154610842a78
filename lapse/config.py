"""Plain configuration objects.

Every operator takes its parameters explicitly; nothing is read from files
or globals inside an operator, and the reference date is always passed in.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class FeatureConfig:
    # Fixed values (defaults of the feature pipeline being matched).
    windows_days: tuple[int, ...] = (7, 14, 30)
    unq_windows: tuple[int, ...] = (7,)
    trend_window_recent: int = 14
    trend_window_prior: int = 14
    age_min_valid: int = 0
    age_max_valid: int = 100
    registered_via_min_freq: float = 0.01
    trend_epsilon: float = 1e-5


@dataclass(frozen=True)
class BusinessConfig:
    # Fixed values (business assumptions being matched).
    avg_customer_lifespan_months: float = 20
    discount_cost_percentage: float = 0.05
    retention_success_rate: float = 0.3
    default_monthly_revenue: float = 149

    def with_overrides(self, discount_cost=None, retention_rate=None) -> "BusinessConfig":
        """Pure override (the caller's object is never mutated)."""
        out = self
        if discount_cost is not None:
            out = replace(out, discount_cost_percentage=float(discount_cost))
        if retention_rate is not None:
            out = replace(out, retention_success_rate=float(retention_rate))
        return out


@dataclass(frozen=True)
class RiskThresholds:
    # Published tier cutoffs (p95 / p85 of held-out scores).
    high: float = 0.2533
    medium: float = 0.1687


@dataclass(frozen=True)
class ServeConfig:
    # Fixed values (serving limits being matched).
    max_batch_size: int = 1000
    top_drivers_n: int = 3
    low_confidence_threshold_days: int = 14
    top_n_default: int = 10
    top_n_max: int = 100


@dataclass(frozen=True)
class DiversifyQuotas:
    # Strata of the diversified action list.
    high: int = 4
    medium: int = 3
    low_new: int = 3
    low_new_max_tenure_days: int = 180


# Driver -> action families used by the retention action rule,
# checked in this order for each risk-raising driver.
PAYMENT_FRICTION = ("payment_method_id", "is_cancel", "days_since_last_transaction")
RENEWAL_TIMING = ("days_until_expire", "is_auto_renew")
PRICE_SENSITIVITY = ("plan_list_price", "actual_amount_paid", "payment_plan_days")

ACTION_PAYMENT = "Offer alternative payment method"
ACTION_RENEWAL = "Proactive renewal outreach"
ACTION_DISCOUNT = "Offer discount"
ACTION_FALLBACK_HIGH = "Send targeted retention offer"
ACTION_MEDIUM = "Send engagement email"
ACTION_LOW = "No action needed"

# Model-input feature order (31 features).
MODEL_FEATURES = (
    "city", "gender", "age_clean", "registered_via_clean", "plan_list_price",
    "payment_plan_days", "is_auto_renew", "payment_method_id", "num_plan_changes",
    "num_payment_methods", "num_cancellations", "days_since_last_transaction",
    "days_since_registration", "days_until_expire", "days_since_last_log",
    "active_days_7", "avg_songs_100_7", "avg_secs_7", "avg_unq_7",
    "active_days_14", "avg_songs_100_14", "avg_secs_14",
    "active_days_30", "avg_songs_100_30", "avg_secs_30",
    "recent_avg_secs", "recent_avg_songs", "prior_avg_secs", "prior_avg_songs",
    "engagement_trend_secs_ratio", "engagement_trend_songs_ratio",
)

CATEGORICAL_FEATURES = ("city", "gender", "age_clean", "registered_via_clean", "payment_method_id")

# Columns never fed to the model (raw log columns and outputs).
NON_MODEL_COLUMNS = (
    "total_secs", "num_25", "num_50", "num_75", "num_985", "num_100", "num_unq",
    "log_days", "avg_secs_per_day", "percent_complete", "daily_unq_songs",
    "engagement_trend_total_secs", "engagement_trend_num_unq",
    "churn_probability", "estimated_clv", "expected_value", "actual_amount_paid",
)

# Display labels for features (dashboard naming).
FEATURE_LABELS = {
    "registered_via_clean": "Registration Channel",
    "age_clean": "Age",
    "days_since_registration": "Membership Tenure",
    "payment_method_id": "Payment Method",
    "days_until_expire": "Days Until Renewal",
    "city": "City",
    "gender": "Gender",
    "days_since_last_transaction": "Days Since Last Payment",
    "is_auto_renew": "Auto-Renewal Status",
    "plan_list_price": "Plan Price",
    "num_plan_changes": "Plan Changes",
    "num_cancellations": "Past Cancellations",
    "payment_plan_days": "Plan Duration",
    "num_payment_methods": "Payment Methods Used",
    "days_since_last_log": "Days Since Last Listened",
}


@dataclass(frozen=True)
class Settings:
    features: FeatureConfig = field(default_factory=FeatureConfig)
    business: BusinessConfig = field(default_factory=BusinessConfig)
    thresholds: RiskThresholds = field(default_factory=RiskThresholds)
    serve: ServeConfig = field(default_factory=ServeConfig)
    quotas: DiversifyQuotas = field(default_factory=DiversifyQuotas)
