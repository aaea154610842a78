"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's whole tables through the test views and runs
the library operators on them; nothing is capped or sampled unless sampling
or top-k is the operator itself.  ``for_oracle`` only normalises the output
for the side-by-side comparison with DuckDB (doubles rounded to 6 places,
dates as ISO text).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapse.config import Settings
from lapse.operators import features as fb
from lapse.operators import labels as lb
from lapse.operators import logs as lg
from lapse.operators import categories as cat
from lapse.operators.value import score_customers
from lapse.sources import testviews as tv
from lapse.operators import cohort as ch
from lapse.operators import rank as rk
from lapse.operators import serve as sv
from lapse.operators.value import estimated_clv_flat
from lapse.operators import evaluate as ev
from lapse.operators import profile as pf
from lapse.operators import attribute as at
from lapse.operators import ml
from lapse.operators import asof, idsearch
from lapse.operators import isotonic as iso
from lapse.operators import sketches as sk
from lapse.operators import snapshots as sn
from lapse.operators import transactions as tr
from lapse.plans.jobs import load_ensemble, model_actions, save_ensemble
from lapse.session import materialize, shared_folder
from lapse.sources import commits, readers, serving, writers

S = Settings()
REF = tv.REFERENCE_DATE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def round6(c):
    """Round half up on the binary value: floor(x * 1e6 + 0.5) / 1e6.  Plain IEEE
    arithmetic, so every engine gives the same double (``round`` differs
    between engines on exact halves)."""
    x = c.cast("double")
    return F.when(F.abs(x) < F.lit(1e15), F.floor(x * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).otherwise(x)


def for_oracle(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = round6(c)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ------------------------------------------------------------- shared builders

def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FB5 over the test views: base = labelled customers, ref = REF."""
    train = tv.train(spark, sf_dir)   # one row per customer by construction (a groupBy output)
    return fb.build_customer_feature_table(
        tv.members(spark, sf_dir), tv.transactions(spark, sf_dir), tv.user_logs(spark, sf_dir, until=REF),
        train, REF, S.features)


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4 over the feature table with the deterministic stand-in score."""
    f = feature_table(spark, sf_dir).withColumn("churn_probability", tv.stand_in_probability())
    return score_customers(f, S.business, S.thresholds, S.serve)


# ------------------------------------------------------------ phase 1: logs

@register("log_aggregate")
def q_log_aggregate(spark, sf_dir):
    return for_oracle(lg.aggregate_logs(tv.user_logs(spark, sf_dir, until=REF), REF, S.features))


@register("engagement_features")
def q_engagement_features(spark, sf_dir):
    base = tv.train(spark, sf_dir).select("msno").dropDuplicates(["msno"])
    agg = lg.aggregate_logs(tv.user_logs(spark, sf_dir, until=REF), REF, S.features)
    return for_oracle(fb.build_engagement_features(agg, base, S.features))


@register("lifetime_log_stats")
def q_lifetime_log_stats(spark, sf_dir):
    return for_oracle(lg.lifetime_log_stats(tv.user_logs(spark, sf_dir)))


# ------------------------------------------------------- phase 2: features

@register("same_day_dedup")
def q_same_day_dedup(spark, sf_dir):
    return for_oracle(tv.transactions(spark, sf_dir, reference_date=None))


@register("cutoff_transactions")
def q_cutoff_transactions(spark, sf_dir):
    return for_oracle(tv.transactions(spark, sf_dir, reference_date=REF))


@register("registered_via_frequency")
def q_registered_via_frequency(spark, sf_dir):
    return for_oracle(cat.category_frequency(tv.members(spark, sf_dir), "registered_via"))


@register("demographic_features")
def q_demographic_features(spark, sf_dir):
    base = tv.train(spark, sf_dir).select("msno").dropDuplicates(["msno"])
    return for_oracle(fb.build_demographic_features(tv.members(spark, sf_dir), base, S.features, REF))


@register("transaction_features")
def q_transaction_features(spark, sf_dir):
    base = tv.train(spark, sf_dir).select("msno").dropDuplicates(["msno"])
    return for_oracle(fb.build_transaction_features(tv.transactions(spark, sf_dir), base, REF))


@register("tenure_features")
def q_tenure_features(spark, sf_dir):
    base = tv.train(spark, sf_dir).select("msno").dropDuplicates(["msno"])
    return for_oracle(fb.build_tenure_features(tv.members(spark, sf_dir), tv.transactions(spark, sf_dir),
                                               base, REF, S.features))


@register("customer_feature_table")
def q_customer_feature_table(spark, sf_dir):
    return for_oracle(feature_table(spark, sf_dir))


@register("churn_labels")
def q_churn_labels(spark, sf_dir):
    tx = tv.raw_transactions(spark, sf_dir)
    return for_oracle(lb.label_churn(tx, tv.LABEL_CUTOFF, tv.LABEL_GAP_DAYS, seq_col="seq"))


@register("class_balance")
def q_class_balance(spark, sf_dir):
    return for_oracle(lb.class_balance(tv.train(spark, sf_dir)))


# ------------------------------------------------- phase 3: value and serving


ACTION_COLUMNS = ("msno", "expected_value", "churn_probability", "estimated_clv")


@register("scored_customers")
def q_scored_customers(spark, sf_dir):
    from lapse.functions.clean import retention_score
    return for_oracle(scored_table(spark, sf_dir).select("msno", *sv.PREDICTION_COLUMNS,
                                                         retention_score("churn_probability").alias("retention_score")))


@register("clv_flat")
def q_clv_flat(spark, sf_dir):
    tx = tv.transactions(spark, sf_dir)
    return for_oracle(tx.select("msno", "seq", estimated_clv_flat(tx, S.business).alias("estimated_clv")))


@register("prioritized_actions")
def q_prioritized_actions(spark, sf_dir):
    df = scored_table(spark, sf_dir).select("msno", "churn_probability", "plan_list_price", "payment_plan_days")
    return for_oracle(rk.ranked(rk.prioritized_action_list(df, S.business)).select("rank", *ACTION_COLUMNS))


@register("top_actions")
def q_top_actions(spark, sf_dir):
    return for_oracle(rk.top_n(scored_table(spark, sf_dir), 10).select(*ACTION_COLUMNS))


@register("top_actions_repriced")
def q_top_actions_repriced(spark, sf_dir):
    df = rk.reprice(scored_table(spark, sf_dir), S.business, discount_cost=0.1, retention_rate=0.5)
    return for_oracle(rk.top_n(df, 10).select(*ACTION_COLUMNS))


@register("top_actions_segment")
def q_top_actions_segment(spark, sf_dir):
    df = ch.segment_filter(scored_table(spark, sf_dir), plan_type=30, tenure="old")
    return for_oracle(rk.top_n(df, 10).select(*ACTION_COLUMNS))


@register("diversified_actions")
def q_diversified_actions(spark, sf_dir):
    return for_oracle(rk.diversified_top_n(scored_table(spark, sf_dir), 10, S.thresholds, S.quotas)
                      .select(*ACTION_COLUMNS))


@register("diversified_actions_wide")
def q_diversified_actions_wide(spark, sf_dir):
    df = ch.segment_filter(scored_table(spark, sf_dir), plan_type=30)
    return for_oracle(rk.diversified_top_n(df, 25, S.thresholds, S.quotas).select(*ACTION_COLUMNS))


def _cohort(spark, sf_dir, plan_type=None, tenure=None):
    out = ch.cohort_stats(scored_table(spark, sf_dir), plan_type, tenure, S.thresholds)
    tiers = F.array_sort(F.map_entries("risk_tier_distribution"))     # the map as comparable text, in tier order
    text = F.array_join(F.transform(tiers, lambda e: F.concat_ws("=", e["key"], F.floor(e["value"] * 1e6 + 0.5).cast("long").cast("string"))), ",")
    return for_oracle(out.withColumn("risk_tier_distribution", text))


@register("cohort_stats_all")
def q_cohort_stats_all(spark, sf_dir):
    return _cohort(spark, sf_dir)


@register("cohort_stats_segment")
def q_cohort_stats_segment(spark, sf_dir):
    return _cohort(spark, sf_dir, plan_type=30, tenure="old")


@register("cohort_stats_empty")
def q_cohort_stats_empty(spark, sf_dir):
    return _cohort(spark, sf_dir, plan_type=-12345)


@register("segment_cube")
def q_segment_cube(spark, sf_dir):
    return for_oracle(ch.segment_cube(scored_table(spark, sf_dir), S.thresholds))


@register("risk_distribution")
def q_risk_distribution(spark, sf_dir):
    return for_oracle(ch.risk_distribution(scored_table(spark, sf_dir), S.thresholds))


@register("customer_profile")
def q_customer_profile(spark, sf_dir):
    return for_oracle(sv.customer_profile(scored_table(spark, sf_dir), "10"))


@register("search_ids")
def q_search_ids(spark, sf_dir):
    return for_oracle(sv.search_ids(scored_table(spark, sf_dir), "12", 10))


@register("url_safe_ids")
def q_url_safe_ids(spark, sf_dir):
    return for_oracle(sv.url_safe_ids(scored_table(spark, sf_dir), 50))


@register("seeded_sample")
def q_seeded_sample(spark, sf_dir):
    return for_oracle(sv.seeded_sample(scored_table(spark, sf_dir).select("msno"), 50, 42))


def member_requests(spark, sf_dir) -> DataFrame:
    """Every member id as a batch request: batches of 1000 ids by customer key."""
    c = tv.table(spark, sf_dir, "customer")
    return c.select(F.floor(F.col("c_custkey") / 1000).cast("long").alias("request_id"),
                    (F.col("c_custkey") % 1000).cast("int").alias("pos"),
                    F.col("c_custkey").cast("string").alias("msno"))


@register("batch_lookup")
def q_batch_lookup(spark, sf_dir):
    return for_oracle(sv.batch_lookup(member_requests(spark, sf_dir), scored_table(spark, sf_dir)))


@register("usage_history")
def q_usage_history(spark, sf_dir):
    return for_oracle(sv.usage_history(tv.user_logs(spark, sf_dir)))


@register("usage_share_of_max")
def q_usage_share_of_max(spark, sf_dir):
    return for_oracle(sv.usage_share_of_max(tv.user_logs(spark, sf_dir)))


def what_if_scenarios(scored: DataFrame) -> DataFrame:
    """Three scenarios for every scored customer (one projection each)."""
    ids = scored.select("msno")
    null_d, null_i = F.lit(None).cast("double"), F.lit(None).cast("int")
    return (ids.select(F.lit("auto_renew_on").alias("scenario_id"), "msno", null_d.alias("plan_list_price"),
                       null_i.alias("payment_plan_days"), F.lit(1).alias("is_auto_renew"),
                       null_i.alias("days_since_registration"))
               .unionByName(ids.select(F.lit("annual_plan_99").alias("scenario_id"), "msno",
                                       F.lit(99.0).alias("plan_list_price"), F.lit(410).alias("payment_plan_days"),
                                       null_i.alias("is_auto_renew"), null_i.alias("days_since_registration")))
               .unionByName(ids.select(F.lit("new_member").alias("scenario_id"), "msno", null_d.alias("plan_list_price"),
                                       null_i.alias("payment_plan_days"), null_i.alias("is_auto_renew"),
                                       F.lit(7).alias("days_since_registration"))))


@register("what_if")
def q_what_if(spark, sf_dir):
    scored = scored_table(spark, sf_dir)
    out = sv.simulate(what_if_scenarios(scored), scored,
                      lambda df: df.withColumn("churn_probability", tv.stand_in_probability()),
                      S.business, S.thresholds, S.serve)
    return for_oracle(out)


# ----------------------------------------------- phase 4: profiles and EDA



@register("null_percent_members")
def q_null_percent_members(spark, sf_dir):
    return for_oracle(pf.null_percent(tv.members(spark, sf_dir)))


@register("null_percent_transactions")
def q_null_percent_transactions(spark, sf_dir):
    return for_oracle(pf.null_percent(tv.raw_transactions(spark, sf_dir)))


@register("duplicate_transactions")
def q_duplicate_transactions(spark, sf_dir):
    return for_oracle(pf.duplicate_count(tv.raw_transactions(spark, sf_dir), ["msno", "transaction_date"]))


@register("transaction_date_range")
def q_transaction_date_range(spark, sf_dir):
    return for_oracle(pf.date_range(tv.raw_transactions(spark, sf_dir), ["transaction_date", "membership_expire_date"]))


@register("monthly_transactions")
def q_monthly_transactions(spark, sf_dir):
    return for_oracle(pf.monthly_counts(tv.raw_transactions(spark, sf_dir), "transaction_date"))


@register("key_coverage")
def q_key_coverage(spark, sf_dir):
    others = {"members": tv.members(spark, sf_dir), "transactions": tv.raw_transactions(spark, sf_dir),
              "user_logs": tv.user_logs(spark, sf_dir)}
    return for_oracle(pf.key_coverage(tv.train(spark, sf_dir), others))


@register("distinct_log_ids")
def q_distinct_log_ids(spark, sf_dir):
    return for_oracle(pf.distinct_ids(tv.user_logs(spark, sf_dir)))


@register("listening_by_label")
def q_listening_by_label(spark, sf_dir):
    return for_oracle(pf.listening_by_label(tv.user_logs(spark, sf_dir), tv.train(spark, sf_dir)))


@register("churn_rate_by_city")
def q_churn_rate_by_city(spark, sf_dir):
    return for_oracle(pf.churn_rate_by(tv.train(spark, sf_dir), tv.members(spark, sf_dir), "city"))


@register("member_profile")
def q_member_profile(spark, sf_dir):
    return for_oracle(pf.table_profile(tv.members(spark, sf_dir)))


@register("transaction_profile")
def q_transaction_profile(spark, sf_dir):
    return for_oracle(pf.table_profile(tv.raw_transactions(spark, sf_dir)))


@register("log_profile")
def q_log_profile(spark, sf_dir):
    return for_oracle(pf.table_profile(tv.user_logs(spark, sf_dir)))


@register("label_profile")
def q_label_profile(spark, sf_dir):
    return for_oracle(pf.table_profile(tv.train(spark, sf_dir)))


@register("table_types")
def q_table_types(spark, sf_dir):
    views = {"members": tv.members, "transactions": tv.raw_transactions, "user_logs": tv.user_logs, "train": tv.train}
    return pf.column_types({name: view(spark, sf_dir) for name, view in views.items()})


@register("score_histogram")
def q_score_histogram(spark, sf_dir):
    return for_oracle(ev.score_histogram(scored_table(spark, sf_dir), "churn_probability", 50))


# ---------------------------------------------------- phase 5: evaluation

@register("roc_auc")
def q_roc_auc(spark, sf_dir):
    return for_oracle(ev.roc_auc(scored_table(spark, sf_dir)))


@register("average_precision")
def q_average_precision(spark, sf_dir):
    return for_oracle(ev.average_precision(scored_table(spark, sf_dir)))


@register("confusion_at_half")
def q_confusion_at_half(spark, sf_dir):
    return for_oracle(ev.confusion(scored_table(spark, sf_dir), 0.5))


@register("confusion_report")
def q_confusion_report(spark, sf_dir):
    return for_oracle(ev.confusion(scored_table(spark, sf_dir), 0.245))


@register("score_summary")
def q_score_summary(spark, sf_dir):
    """All headline measures from one threshold table."""
    return for_oracle(ev.summary(scored_table(spark, sf_dir), 0.245))


@register("roc_curve")
def q_roc_curve(spark, sf_dir):
    return for_oracle(ev.roc_curve(scored_table(spark, sf_dir), 100))


@register("pr_curve")
def q_pr_curve(spark, sf_dir):
    return for_oracle(ev.pr_curve(scored_table(spark, sf_dir), 100))


@register("calibration_curve")
def q_calibration_curve(spark, sf_dir):
    return for_oracle(ev.calibration_curve(scored_table(spark, sf_dir), 10))


@register("score_percentiles")
def q_score_percentiles(spark, sf_dir):
    return for_oracle(ev.exact_percentiles(scored_table(spark, sf_dir), "churn_probability", [0.95, 0.85]))


@register("tier_thresholds")
def q_tier_thresholds(spark, sf_dir):
    return for_oracle(ev.tier_thresholds(scored_table(spark, sf_dir)))


# ------------------------------------------------------- phase 6: modelling



def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table with exact stratified split and folds (M1 + M2)."""
    return ml.stratified_split(feature_table(spark, sf_dir), 0.2, 3, 42)


def fit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`split_table`, materialised; the split reads the feature table twice, so that is too."""
    return materialize(ml.stratified_split(materialize(feature_table(spark, sf_dir)), 0.2, 3, 42))


@register("train_test_split")
def q_train_test_split(spark, sf_dir):
    return for_oracle(split_table(spark, sf_dir).select("msno", "is_churn", "split", "fold"))


@register("class_weights")
def q_class_weights(spark, sf_dir):
    train = split_table(spark, sf_dir).filter(F.col("split") == "train")
    return for_oracle(ml.with_class_weights(train).select("msno", "is_churn", "weight"))


def _model_folder(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """Where the (seeded, deterministic) model of these tables, at their change times, is kept in the
    session's shared folder: queries that read one model load it, the first one fits it."""
    parts = [sf_dir, kind]
    for name in ("customer", "orders", "events"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        parts.append(str(path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()))
    return f"{shared_folder(spark).rstrip('/')}/models/{kind}-{hashlib.md5('|'.join(parts).encode()).hexdigest()}"


def _fit_linear(spark, sf_dir):
    data = fit_table(spark, sf_dir)
    train = materialize(ml.with_class_weights(data.filter(F.col("split") == "train"), mode="balanced"))

    def fit() -> None:
        writers.save_model(ml.linear_pipeline(reg_param=ml.l2_for_c(train, 1.0)).fit(train), f"{folder}/model")

    folder = _model_folder(spark, sf_dir, "linear")
    commits.once(spark, folder, fit)
    return writers.load_model(f"{folder}/model"), data, train


@register("linear_baseline_scores")
def q_linear_baseline_scores(spark, sf_dir):
    model, data, _ = _fit_linear(spark, sf_dir)
    return for_oracle(ml.score(model, data.filter(F.col("split") == "test")))


@register("linear_baseline_metrics")
def q_linear_baseline_metrics(spark, sf_dir):
    model, data, _ = _fit_linear(spark, sf_dir)
    scores = ml.score(model, data.filter(F.col("split") == "test"))
    return for_oracle(ev.summary(scores, 0.5).withColumnRenamed("pr_auc", "average_precision"))


@register("linear_contributions")
def q_linear_contributions(spark, sf_dir):
    model, data, train = _fit_linear(spark, sf_dir)
    contrib = at.linear_contributions(model, data, train)
    return for_oracle(at.contributions_long(contrib))


def _fit_calibrated_trees(spark, sf_dir):
    data = fit_table(spark, sf_dir)

    def fit() -> None:
        train = materialize(ml.sized(ml.with_class_weights(data.filter(F.col("split") == "train"))))
        params = ml.with_bins(ml.TreeParams(), train)
        fitted.append(ml.fit_calibrated(train, lambda: ml.tree_pipeline(params), folds=3))
        save_ensemble(fitted[0], folder)

    fitted, folder = [], _model_folder(spark, sf_dir, "trees")
    commits.once(spark, folder, fit)
    return fitted[0] if fitted else load_ensemble(folder, 3), data


@register("calibrated_tree_scores")
def q_calibrated_tree_scores(spark, sf_dir):
    ens, data = _fit_calibrated_trees(spark, sf_dir)
    test = data.filter(F.col("split") == "test")
    return for_oracle(ens.transform(test).select("msno", "is_churn", "churn_probability"))


def _tree_attribution(spark, sf_dir):
    """X1 (trees) from the first fold's uncalibrated model, on every row."""
    from lapse.operators.treeshap import tree_contributions
    ens, data = _fit_calibrated_trees(spark, sf_dir)
    return tree_contributions(ens.members[0][0], data)


@register("tree_drivers")
def q_tree_drivers(spark, sf_dir):
    contrib = _tree_attribution(spark, sf_dir)
    d = at.top_drivers(F.col("contributions"), S.serve.top_drivers_n)
    return for_oracle(contrib.select("msno", F.posexplode(at.driver_strings(d)).alias("rank", "driver")))


@register("tree_global_drivers")
def q_tree_global_drivers(spark, sf_dir):
    contrib = _tree_attribution(spark, sf_dir)
    return for_oracle(at.impact_share_of_max(at.global_drivers(at.contributions_long(contrib), 15)))


# ---------------------------------------------- phase 7: attribution, actions

def standin_attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at.standin_contributions(scored_table(spark, sf_dir))


@register("feature_contributions")
def q_feature_contributions(spark, sf_dir):
    return for_oracle(at.contributions_long(standin_attributed(spark, sf_dir)))


@register("top_drivers")
def q_top_drivers(spark, sf_dir):
    df = standin_attributed(spark, sf_dir)
    d = at.top_drivers(F.col("contributions"), S.serve.top_drivers_n)
    return for_oracle(df.select("msno", F.posexplode(at.driver_strings(d)).alias("rank", "driver")))


@register("retention_actions")
def q_retention_actions(spark, sf_dir):
    df = standin_attributed(spark, sf_dir)
    d = at.top_drivers(F.col("contributions"), S.serve.top_drivers_n)
    return for_oracle(df.select("msno", "risk_tier", at.retention_action(F.col("risk_tier"), d).alias("suggested_action")))


@register("global_drivers")
def q_global_drivers(spark, sf_dir):
    from lapse.functions.clean import feature_label
    contrib = standin_attributed(spark, sf_dir)
    g = at.impact_share_of_max(at.global_drivers(at.contributions_long(contrib), 15))
    return for_oracle(g.withColumn("label", feature_label("feature")))


@register("model_input")
def q_model_input(spark, sf_dir):
    return for_oracle(ml.model_input(scored_table(spark, sf_dir), keep=("msno",)))


# ------------------------------------------ many dates, states, layouts

# Twelve month ends, and twelve reference dates around the days that hold logs.
CUTOFFS = ("2000-01-31", "2000-02-29", "2000-03-31", "2000-04-30", "2000-05-31", "2000-06-30",
           "2000-07-31", "2000-08-31", "2000-09-30", "2000-10-31", "2000-11-30", "2000-12-31")
SNAPSHOTS = ("2001-07-01", "2001-07-05", "2001-07-10", "2001-07-15", "2001-07-20", "2001-07-25",
             "2001-07-28", "2001-07-31", "2001-08-10", "2001-08-31", "2001-09-15", "2001-12-31")


@register("churn_labels_monthly")
def q_churn_labels_monthly(spark, sf_dir):
    return for_oracle(lb.label_churn_at_all(tv.raw_transactions(spark, sf_dir), list(CUTOFFS), tv.LABEL_GAP_DAYS, seq_col="seq"))


@register("churn_labels_asof")
def q_churn_labels_asof(spark, sf_dir):
    """Each member's own cutoffs: one to five years after registration."""
    years = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("y")
    cutoffs = tv.members(spark, sf_dir).select("msno", "registration_init_time", years).select(
        "msno", F.date_add("registration_init_time", F.col("y") * 365).alias("cutoff_date"))
    return for_oracle(lb.label_churn_asof(tv.raw_transactions(spark, sf_dir), cutoffs, tv.LABEL_GAP_DAYS, seq_col="seq"))


@register("price_as_of_log")
def q_price_as_of_log(spark, sf_dir):
    """Each log day with the plan of the customer's latest transaction day before or on it."""
    tx = tv.raw_transactions(spark, sf_dir)
    out = asof.asof_join(tv.user_logs(spark, sf_dir).select("msno", "log_date", "total_secs"), tx, "msno", "log_date", "transaction_date",
                         ["plan_list_price", "payment_plan_days", "transaction_date"], [F.col("is_cancel"), F.col("plan_list_price"), F.col("seq")])
    return for_oracle(out)


@register("log_snapshots")
def q_log_snapshots(spark, sf_dir):
    return for_oracle(sn.aggregate_snapshots(sn.daily_states(tv.user_logs(spark, sf_dir)), list(SNAPSHOTS), S.features))


@register("engagement_snapshots")
def q_engagement_snapshots(spark, sf_dir):
    base = tv.train(spark, sf_dir).select("msno").dropDuplicates(["msno"])
    return for_oracle(sn.engagement_snapshots(sn.daily_states(tv.user_logs(spark, sf_dir)), base, list(SNAPSHOTS), S.features))


@register("history_from_states")
def q_history_from_states(spark, sf_dir):
    """The transaction history merged from one state per customer, month and payment method."""
    return for_oracle(tr.merged_history(tr.monthly_states(tv.transactions(spark, sf_dir))))


SKETCHED = ("msno", "payment_method_id", "payment_plan_days", "plan_list_price", "seq")


def _monthly_sketches(spark, sf_dir):
    """Sketches per month of the transactions, merged to those of the whole table."""
    tx = tv.raw_transactions(spark, sf_dir).withColumn("month", F.trunc("transaction_date", "month"))
    return tx, sk.merged_states(sk.sketch_states(tx, list(SKETCHED), ["month"]))


@register("sketch_distinct_counts")
def q_sketch_distinct_counts(spark, sf_dir):
    """Merged estimates next to exact counts: whether each is within its bound."""
    tx, merged = _monthly_sketches(spark, sf_dir)
    exact = tx.agg(*(F.count_distinct(c).alias(c) for c in SKETCHED)).unpivot([], list(SKETCHED), "column", "exact")
    found = sk.distinct_counts(merged).join(exact, "column")
    within = F.abs(F.col("n_distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * sk.DISTINCT_ERROR)
    return for_oracle(found.select("column", "n", "n_null", F.col("exact").alias("n_distinct"), within.alias("within_bound")))


@register("sketch_quantiles")
def q_sketch_quantiles(spark, sf_dir):
    """Merged quantiles, each checked against the exact rank of its value."""
    tx, merged = _monthly_sketches(spark, sf_dir)
    found = sk.quantiles(merged, [0.05, 0.25, 0.5, 0.75, 0.95])
    return for_oracle(sk.rank_errors(tx.select(*SKETCHED), found).select(
        "column", "prob", (F.col("error") <= sk.RANK_ERROR).alias("within_bound")))


@register("id_set_overlaps")
def q_id_set_overlaps(spark, sf_dir):
    return pf.set_overlaps({"members": tv.members(spark, sf_dir), "transactions": tv.raw_transactions(spark, sf_dir),
                            "user_logs": tv.user_logs(spark, sf_dir), "train": tv.train(spark, sf_dir)})


def _work(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{what}_{uuid.uuid4().hex}"


@register("batch_lookup_bucketed")
def q_batch_lookup_bucketed(spark, sf_dir):
    """J11 on the bucketed layout: the requests move, the scored table doesn't."""
    path = _work(spark, "serving")
    table = serving.write_serving_table(scored_table(spark, sf_dir), path.rsplit("/", 1)[1], path, buckets=8)
    return for_oracle(sv.batch_lookup(member_requests(spark, sf_dir), table))


@register("search_ids_indexed")
def q_search_ids_indexed(spark, sf_dir):
    """P9 for every distinct tail of an id (from its second character, four at most) and every
    whole id, through the posting table."""
    ids, path = tv.members(spark, sf_dir).select("msno"), _work(spark, "postings")
    idsearch.write_postings(ids, path)
    asked = ids.select(F.substring("msno", 2, 4).alias("query")).union(ids.select("msno")).distinct()
    found = idsearch.search(asked, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), 10)
    return found.drop("candidates")


@register("isotonic_calibration")
def q_isotonic_calibration(spark, sf_dir):
    return for_oracle(iso.calibrated_scores(scored_table(spark, sf_dir)))


# Sources as text, as the CSV readers give them: dates as yyyyMMdd, some of them broken.

def _date_text(c, broken):
    return F.when(broken, F.concat(F.date_format(c, "yyyyMM"), F.lit("3x"))).otherwise(F.date_format(c, "yyyyMMdd"))


@register("members_parsed")
def q_members_parsed(spark, sf_dir):
    m = tv.members(spark, sf_dir)
    raw = m.withColumn("registration_init_time", _date_text("registration_init_time", F.col("msno").cast("long") % 7 == 0))
    return for_oracle(readers.parse_members(raw))


@register("transactions_parsed")
def q_transactions_parsed(spark, sf_dir):
    t = tv.raw_transactions(spark, sf_dir)
    raw = t.withColumns({"transaction_date": _date_text("transaction_date", F.col("seq") % 11 == 0),
                         "membership_expire_date": _date_text("membership_expire_date", F.col("seq") % 13 == 0)})
    return for_oracle(readers.prepare_transactions(readers.parse_transactions(raw), REF, seq_col="seq"))


@register("user_logs_parsed")
def q_user_logs_parsed(spark, sf_dir):
    u = tv.user_logs(spark, sf_dir)
    raw = u.withColumn("date", _date_text("log_date", F.col("msno").cast("long") % 17 == 0)).drop("log_date")
    return for_oracle(readers.parse_user_logs(raw))


# Fitted models, checked row by row: what must hold whatever the fit found.

ACTION_RULE = """CASE risk_tier WHEN 'Low' THEN 'No action needed' WHEN 'Medium' THEN 'Send engagement email' ELSE
  coalesce(try_element_at(filter(transform(filter(top_drivers, d -> d LIKE '% (High)'), d -> CASE
    WHEN substring(d, 1, length(d) - 7) IN ('payment_method_id', 'is_cancel', 'days_since_last_transaction') THEN 'Offer alternative payment method'
    WHEN substring(d, 1, length(d) - 7) IN ('days_until_expire', 'is_auto_renew') THEN 'Proactive renewal outreach'
    WHEN substring(d, 1, length(d) - 7) IN ('plan_list_price', 'actual_amount_paid', 'payment_plan_days') THEN 'Offer discount' END),
    a -> a IS NOT NULL), 1), 'Send targeted retention offer') END"""


@register("linear_score_checks")
def q_linear_score_checks(spark, sf_dir):
    """Held-out rows: the score is a probability, and the sigmoid of base + contributions."""
    model, data, train = _fit_linear(spark, sf_dir)
    test = data.filter(F.col("split") == "test")
    attributed = at.linear_contributions(model, test, train).select("msno", "contributions", "base_value")
    both = ml.score(model, test).join(attributed, "msno")
    margin = F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["contribution"])
    p = F.col("churn_probability")
    return both.select("msno", p.between(0, 1).alias("in_range"), (F.abs(p - 1 / (1 + F.exp(-margin))) < 1e-9).alias("is_sigmoid"))


@register("model_action_checks")
def q_model_action_checks(spark, sf_dir):
    """Every customer, from the fitted trees: score in range, base + contributions = margin, three
    drivers, and the action that the rule (spelled out in SQL) gives for them."""
    ens, data = _fit_calibrated_trees(spark, sf_dir)
    scored = model_actions(data, ens, S.business, S.thresholds, S.serve).withColumn("top_drivers", at.driver_strings(F.col("drivers")))
    total = F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["contribution"])
    return scored.select("msno", F.col("churn_probability").between(0, 1).alias("in_range"),
                         (F.abs(total - F.col("margin")) < 1e-9).alias("adds_up"), F.size("top_drivers").alias("n_drivers"),
                         (F.col("suggested_action") == F.expr(ACTION_RULE)).alias("follows_rule"))


@register("calibration_checks")
def q_calibration_checks(spark, sf_dir):
    """Each fold's calibration: its scores in order never fall, and lie in [0, 1]."""
    ens, data = _fit_calibrated_trees(spark, sf_dir)
    out = None
    for k, (base, calibration) in enumerate(ens.members):
        raw = ml.positive_probability(base.transform(data), "_raw")
        pairs = calibration.setFeaturesCol("_raw").setPredictionCol("_cal").transform(raw).select("_raw", "_cal")
        part = iso.order_checks(pairs, "_raw", "_cal").select(F.lit(k).alias("fold"), "never_falls", "in_range")
        out = part if out is None else out.unionByName(part)
    return out


# The small grid on which the parameter search is registered.
SEARCH_TRIALS, SEARCH_FOLDS, SEARCH_ROUNDS = 2, 3, 5


@register("tree_search_trials")
def q_tree_search_trials(spark, sf_dir):
    """M7 on a small grid: each trial's mean average precision in range, one trial best."""
    _, data = _fit_calibrated_trees(spark, sf_dir)
    train = materialize(ml.sized(ml.with_class_weights(data.filter(F.col("split") == "train"))))
    best, trials = ml.search_tree_params(train, SEARCH_TRIALS, SEARCH_FOLDS, ml.TreeParams(max_iter=SEARCH_ROUNDS, max_depth=3))
    top = max(s for _, s in trials)
    rows = [(i, 0.0 <= s <= 1.0, p == best, s == top) for i, (p, s) in enumerate(trials)]
    return spark.createDataFrame(rows, "trial int, in_range boolean, is_best boolean, is_top boolean").select(
        "trial", "in_range", (F.col("is_best") == F.col("is_top")).alias("best_is_top"))
