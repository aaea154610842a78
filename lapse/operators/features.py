"""Point-in-time customer feature builders (FB1-FB5, J1-J6).

Every family is keyed on ``msno`` and left-joined to the base cohort.  The
full table (FB5) builds each fact aggregate once and joins three inputs on
the same key; the joins reuse the partitioning of the aggregates, so no exchange
is added for them.  Members and labels are
per-customer tables that grow with the data and are never broadcast; only
the rare-category list (bounded by 1/min_freq) is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.config import FeatureConfig
from lapse.functions.clean import UNKNOWN, clean_age, code_text
from lapse.functions.dates import date_lit
from lapse.operators.categories import rollup_rare
from lapse.operators.logs import aggregate_logs
from lapse.operators.transactions import transaction_history

DEMOGRAPHIC_COLUMNS = ("city", "gender", "age_clean", "registered_via_clean")
TRANSACTION_COLUMNS = ("plan_list_price", "payment_plan_days", "is_auto_renew", "payment_method_id",
                       "num_plan_changes", "num_payment_methods", "num_cancellations",
                       "days_since_last_transaction")
TENURE_COLUMNS = ("days_since_registration", "days_until_expire")


def engagement_columns(cfg: FeatureConfig) -> list[str]:
    cols = ["days_since_last_log"]
    for w in cfg.windows_days:
        cols += [f"active_days_{w}", f"avg_songs_100_{w}", f"avg_secs_{w}"]
        if w in cfg.unq_windows:
            cols.append(f"avg_unq_{w}")
    return cols + ["recent_avg_secs", "recent_avg_songs", "prior_avg_secs", "prior_avg_songs"]


# ---------------------------------------------------------------- members side

def member_attributes(members: DataFrame, cfg: FeatureConfig, reference_date) -> DataFrame:
    """Per-member demographic columns (pre-join) plus tenure at the reference date."""
    rolled = rollup_rare(members, "registered_via", members, cfg.registered_via_min_freq,
                         out="registered_via_clean")
    return rolled.select(
        "msno",
        code_text("city").alias("city"),
        F.coalesce(F.col("gender"), F.lit(UNKNOWN)).alias("gender"),
        clean_age("bd", cfg.age_min_valid, cfg.age_max_valid).alias("age_clean"),
        "registered_via_clean",
        F.datediff(date_lit(reference_date), F.col("registration_init_time")).alias("_days_since_registration"),
    )


def _demographic_select() -> list[Column]:
    # Customers absent from members get the same labels as NULL attributes.
    return [
        F.coalesce(F.col("city"), F.lit(UNKNOWN)).alias("city"),
        F.coalesce(F.col("gender"), F.lit(UNKNOWN)).alias("gender"),
        F.coalesce(F.col("age_clean"), F.lit("Unknown/Invalid")).alias("age_clean"),
        F.coalesce(F.col("registered_via_clean"), F.lit(UNKNOWN)).alias("registered_via_clean"),
    ]


def build_demographic_features(members: DataFrame, base: DataFrame,
                               cfg: FeatureConfig = FeatureConfig(), reference_date="1970-01-01") -> DataFrame:
    """FB1 (J1 + F3 + F4 + A11): city, gender, age_clean, registered_via_clean."""
    m = member_attributes(members, cfg, reference_date)
    return base.join(m, "msno", "left").select("msno", *_demographic_select())


# ----------------------------------------------------------- transactions side

def _transaction_select(reference_date) -> list[Column]:
    return [
        F.coalesce(F.col("last_plan_list_price").cast("double"), F.lit(0.0)).alias("plan_list_price"),
        F.coalesce(F.col("last_payment_plan_days").cast("int"), F.lit(0)).alias("payment_plan_days"),
        F.coalesce(F.col("last_is_auto_renew").cast("int"), F.lit(0)).alias("is_auto_renew"),
        code_text("last_payment_method_id").alias("payment_method_id"),
        F.coalesce(F.col("num_plan_changes"), F.lit(0)).cast("long").alias("num_plan_changes"),
        F.coalesce(F.col("num_payment_methods"), F.lit(0)).cast("long").alias("num_payment_methods"),
        F.coalesce(F.col("num_cancellations"), F.lit(0)).cast("long").alias("num_cancellations"),
        F.coalesce(F.datediff(date_lit(reference_date), F.col("last_transaction_date")),
                   F.lit(-1)).alias("days_since_last_transaction"),
    ]


def build_transaction_features(tx: DataFrame, base: DataFrame, reference_date) -> DataFrame:
    """FB2 (D2 + W1 + A7 + A8 + J2 + F2 + F5).  ``tx`` is cutoff-filtered D1 output."""
    hist = transaction_history(tx)
    return base.join(hist, "msno", "left").select("msno", *_transaction_select(reference_date))


def _tenure_select(reference_date) -> list[Column]:
    return [
        F.coalesce(F.col("_days_since_registration"), F.lit(-1)).alias("days_since_registration"),
        F.coalesce(F.datediff(F.col("max_expire_date"), date_lit(reference_date)),
                   F.lit(-999)).alias("days_until_expire"),
    ]


def build_tenure_features(members: DataFrame, tx: DataFrame, base: DataFrame, reference_date,
                          cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """FB3 (A9 + J3 + F2): days since registration (-1), days until max expiry (-999)."""
    reg = members.select("msno", F.datediff(date_lit(reference_date),
                                            F.col("registration_init_time")).alias("_days_since_registration"))
    exp = tx.groupBy("msno").agg(F.max("membership_expire_date").alias("max_expire_date"))
    return (base.join(reg, "msno", "left").join(exp, "msno", "left")
                .select("msno", *_tenure_select(reference_date)))


# ------------------------------------------------------------------- logs side

def _engagement_select(cfg: FeatureConfig) -> list[Column]:
    out = []
    for c in engagement_columns(cfg):
        if c == "days_since_last_log":
            out.append(F.coalesce(F.col(c), F.lit(999)).alias(c))
        elif c.startswith("active_days_"):
            out.append(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c))
        else:
            out.append(F.coalesce(F.col(c), F.lit(0.0)).alias(c))
    return out


def _trend_select(cfg: FeatureConfig) -> list[Column]:
    # A5: ratios of the already-filled averages (a missing prior window is 0,
    # so recent / (0 + eps) is large); a NULL ratio becomes 0.
    eps = F.lit(cfg.trend_epsilon)

    def ratio(r, p):
        return F.coalesce(F.try_divide(F.col(r), F.col(p) + eps), F.lit(0.0))

    return [ratio("recent_avg_secs", "prior_avg_secs").alias("engagement_trend_secs_ratio"),
            ratio("recent_avg_songs", "prior_avg_songs").alias("engagement_trend_songs_ratio")]


def build_engagement_features(logs_agg: DataFrame, base: DataFrame,
                              cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """FB4 (J4 + A5 + sentinels): missing customers get 0, recency 999."""
    filled = base.join(logs_agg, "msno", "left").select("msno", *_engagement_select(cfg))
    return filled.select("*", *_trend_select(cfg))


# ------------------------------------------------------------------ full table

def with_unique_keys(df: DataFrame, name: str, key: str = "msno") -> DataFrame:
    """J5's assertion: ``df`` unchanged, or an error at run time that names a repeated key, which
    would multiply rows in the join.  The aggregate's partitioning is the join's."""
    others = [c for c in df.columns if c != key]
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.max(F.struct(*others)).alias("_row"))
    repeated = F.raise_error(F.concat(F.lit(f"{name} repeat {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return per.select(key, *(F.when(F.col("_rows") > 1, repeated.cast(df.schema[c].dataType)).otherwise(F.col(f"_row.{c}")).alias(c)
                             for c in others))


def feature_columns(cfg: FeatureConfig = FeatureConfig()) -> list[str]:
    return [*DEMOGRAPHIC_COLUMNS, *TRANSACTION_COLUMNS, *TENURE_COLUMNS, *engagement_columns(cfg),
            "engagement_trend_secs_ratio", "engagement_trend_songs_ratio"]


def build_customer_feature_table(members: DataFrame, tx: DataFrame, logs: DataFrame, base: DataFrame,
                                 reference_date, cfg: FeatureConfig = FeatureConfig(),
                                 labels: DataFrame | None = None) -> DataFrame:
    """FB5 (J5 + J6): one row per base row, 31 features, plus ``is_churn`` if labels given.

    ``tx`` must be cutoff-filtered D1 output; ``logs`` are daily rows.  Each fact is aggregated once:
    transactions feed both the transaction and tenure families.  When the
    cohort is the label table itself (unique ids carrying ``is_churn``), pass
    it as ``base`` and the label join (J6) costs nothing extra.
    """
    m = member_attributes(members, cfg, reference_date)
    hist = transaction_history(tx)
    agg = aggregate_logs(logs, reference_date, cfg)
    labelled = labels is not None or "is_churn" in base.columns
    start = base.select("msno", "is_churn") if "is_churn" in base.columns else base.select("msno")
    parts = [m, hist, agg] + ([labels.select("msno", "is_churn")] if labels is not None else [])
    joined = reduce(lambda left, right: left.join(right, "msno", "left"), parts, start)
    cols = ["msno", *_demographic_select(), *_transaction_select(reference_date),
            *_tenure_select(reference_date), *_engagement_select(cfg)]
    if labelled:
        cols.append(F.col("is_churn").cast("int").alias("is_churn"))
    table = joined.select(*cols)
    table = table.select("*", *_trend_select(cfg))
    order = ["msno", *feature_columns(cfg)] + (["is_churn"] if labelled else [])
    return table.select(*order)
