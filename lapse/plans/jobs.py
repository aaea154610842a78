"""The three batch jobs of the system, composed from the operators.

1. :func:`feature_job`  -- features at a reference date + labels -> Parquet
   table and metadata sidecar (FB5, IO5, IO6).
2. :func:`training_job` -- exact split, LR baseline, optional seeded search,
   fold-calibrated boosted trees, held-out metrics, curves, tier thresholds,
   run log, model metadata and saved models (M1-M10, E1-E8, IO9-IO12).
3. :func:`scoring_job`  -- score the whole feature table and add tier, CLV, EV,
   low-confidence, the top drivers of the fitted trees and the suggested action
   (M9, B4, X1, X2, B3), written sorted by ``msno`` so serving queries (lookups,
   top-N, cohorts) are plain scans of it.

Models are fitted and applied on ``ml.model_input``'s columns (P2-P4): features in model
order, numeric NULLs as 0.  The scored table keeps its own NULLs, which the value rules read.

Each job is a handful of Spark actions (writes and model fits); nothing
per-row passes through the driver.
"""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.config import NON_MODEL_COLUMNS, BusinessConfig, FeatureConfig, RiskThresholds, ServeConfig
from lapse.operators import evaluate as ev
from lapse.operators import ml
from lapse.operators.attribute import driver_strings, retention_action, top_drivers
from lapse.operators.features import build_customer_feature_table, with_unique_keys
from lapse.operators.labels import agreed_labels
from lapse.operators.treeshap import with_tree_contributions
from lapse.operators.value import score_customers
from lapse.session import materialize
from lapse.sources import readers, schemas, writers
from lapse.sources.readers import prepare_transactions


def feature_job(spark: SparkSession, members: DataFrame, transactions: DataFrame, logs: DataFrame,
                labels: DataFrame, reference_date, out_dir: str, cfg: FeatureConfig = FeatureConfig(),
                pipeline_version: str = "0.1.0", is_synthetic: bool = False, seq_col: str | None = None,
                snapshots: bool = False) -> str:
    """Entry point 1.  ``transactions`` are typed but not yet cut off or
    deduplicated; ``labels`` (msno, is_churn) define the cohort; contradicting labels of
    one customer, or several member rows, stop the job.  With ``snapshots`` the table keeps one snapshot per reference
    date, and a run replaces its own only."""
    tx = prepare_transactions(transactions, reference_date, seq_col=seq_col)
    base = agreed_labels(labels)
    table = build_customer_feature_table(with_unique_keys(members, "members"), tx, logs, base, reference_date, cfg)
    path = f"{out_dir}/customer_features"
    writers.publish_feature_table(table, path, reference_date,
                                  writers.metadata_record(reference_date, pipeline_version, is_synthetic), snapshots)
    writers.write_metadata(spark, f"{out_dir}/customer_features_metadata", reference_date, pipeline_version,
                           is_synthetic)
    return path


def feature_job_from_files(spark: SparkSession, members_path: str, transactions_path: str, logs_path: str,
                           labels_path: str, reference_date, out_dir: str, **options) -> str:
    """Entry point 1 from the four raw CSV files to the table and its sidecar."""
    transactions = readers.parse_transactions(readers.read_named_csv(spark, transactions_path, schemas.TRANSACTIONS_RAW))
    return feature_job(spark, readers.load_members(spark, members_path), transactions,
                       readers.load_user_logs(spark, logs_path), readers.load_labels(spark, labels_path),
                       reference_date, out_dir, **options)


def save_ensemble(ens: ml.CalibratedEnsemble, path: str) -> None:
    for k, (base, iso) in enumerate(ens.members):
        base.write().overwrite().save(f"{path}/fold_{k}/base")
        iso.write().overwrite().save(f"{path}/fold_{k}/isotonic")


def load_ensemble(path: str, folds: int = 3) -> ml.CalibratedEnsemble:
    return ml.CalibratedEnsemble([(PipelineModel.load(f"{path}/fold_{k}/base"),
                                   IsotonicRegressionModel.load(f"{path}/fold_{k}/isotonic")) for k in range(folds)])


def training_job(spark: SparkSession, features_path: str, out_dir: str, trials: int = 5, folds: int = 3,
                 tree_params: ml.TreeParams = ml.TreeParams(), search_rounds: int = 100,
                 test_fraction: float = 0.2, seed: int = 42, reference_date=None, operating_threshold: float = 0.245,
                 model_version: str = "0.3.0", pipeline_version: str = "0.1.0") -> dict:
    """Entry point 2.  Returns the paths written and the held-out metrics row.

    ``reference_date`` picks a snapshot of an accumulating table.  The report holds the curves
    and the confusion matrix at ``operating_threshold``; the metadata record the version, date,
    calibration, folds and the columns that the model never sees."""
    features = ml.model_input(readers.read_feature_table(spark, features_path, reference_date=reference_date), keep=("msno", ml.LABEL))
    data = materialize(ml.stratified_split(features, test_fraction, folds, seed))
    test = data.filter(F.col("split") == "test")

    # baseline: balanced weights, L2 with C = 1
    lr_train = materialize(ml.with_class_weights(data.filter(F.col("split") == "train"), mode="balanced"))
    lr = ml.linear_pipeline(reg_param=ml.l2_for_c(lr_train)).fit(lr_train)
    lr_metrics = ev.summary(ml.score(lr, test))
    writers.save_model(lr, f"{out_dir}/models/linear_baseline")
    writers.log_run(spark, f"{out_dir}/runs", "Baseline_LR", {"max_iter": 1000, "class_weight": "balanced"},
                    lr_metrics)

    # trees: neg/pos weight, optional seeded search, fold-calibrated ensemble
    train = materialize(ml.sized(ml.with_class_weights(data.filter(F.col("split") == "train"))))
    params = tree_params
    if trials > 0:
        best, _ = ml.search_tree_params(train, trials, folds, replace(tree_params, max_iter=search_rounds), seed=seed)
        params = replace(best, max_iter=tree_params.max_iter)
    params = ml.with_bins(params, train)
    ens = ml.fit_calibrated(train, lambda: ml.tree_pipeline(params), folds)
    save_ensemble(ens, f"{out_dir}/models/calibrated_trees")
    scores = materialize(ens.transform(test).select("msno", "is_churn", "churn_probability"))
    metrics = ev.summary(scores)
    writers.log_run(spark, f"{out_dir}/runs", "Calibrated_trees",
                    {k: v for k, v in asdict(params).items() if k != "extra"}, metrics)
    writers.write_curves({"roc": (ev.roc_curve(scores), "j", "fpr", "tpr"), "pr": (ev.pr_curve(scores), "j", "precision", "recall"),
                          "calibration": (ev.calibration_curve(scores), "bin", "prob_pred", "prob_true")}, f"{out_dir}/curves")
    writers.write_confusion(ev.confusion(scores, operating_threshold), operating_threshold, f"{out_dir}/confusion")
    writers.write_model_metadata(spark, f"{out_dir}/model_metadata", model_version, pipeline_version,
                                 f"isotonic, {folds} folds", NON_MODEL_COLUMNS)
    thresholds = ev.tier_thresholds(scores)
    writers.write_thresholds(thresholds, f"{out_dir}/thresholds")
    return {"linear_model": f"{out_dir}/models/linear_baseline", "tree_model": f"{out_dir}/models/calibrated_trees",
            "thresholds": f"{out_dir}/thresholds", "curves": f"{out_dir}/curves",
            "confusion": f"{out_dir}/confusion", "metadata": f"{out_dir}/model_metadata", "runs": f"{out_dir}/runs",
            "metrics": metrics.first().asDict(), "params": params}


def model_actions(features: DataFrame, ens: ml.CalibratedEnsemble, business: BusinessConfig = BusinessConfig(),
                  thresholds: RiskThresholds = RiskThresholds(), serve: ServeConfig = ServeConfig()) -> DataFrame:
    """M9, B4, X1, X2, B3 in one pass over the feature table: scores, value, the contributions of
    the first fold's trees, the top ``drivers`` and ``suggested_action``; nothing is shuffled."""
    def apply(x: DataFrame) -> DataFrame:
        return with_tree_contributions(ens.members[0][0], ens.transform(x))

    scored = score_customers(ml.through_model(features, apply), business, thresholds, serve)
    scored = scored.withColumn("drivers", top_drivers(F.col("contributions"), serve.top_drivers_n))
    return scored.withColumn("suggested_action", retention_action(F.col("risk_tier"), F.col("drivers")))


def scoring_job(spark: SparkSession, features_path: str, model_path: str, out_path: str,
                thresholds: RiskThresholds | None = None, thresholds_path: str | None = None,
                business: BusinessConfig = BusinessConfig(), serve: ServeConfig = ServeConfig(),
                folds: int = 3, reference_date=None) -> str:
    """Entry point 3: the scored table every serving query reads.  Drivers are those of the
    first fold's trees, on the log-odds scale before calibration."""
    if thresholds is None:
        if not thresholds_path:
            raise ValueError("give this model's thresholds or the path of its threshold table")
        thresholds = ev.thresholds_from_table(spark.read.json(thresholds_path))
    features = readers.read_feature_table(spark, features_path, reference_date=reference_date)
    scored = model_actions(features, load_ensemble(model_path, folds), business, thresholds, serve)
    scored = scored.withColumn("top_drivers", driver_strings(F.col("drivers"))).drop("drivers", "base_value", "margin", "contributions")
    writers.publish_feature_table(scored, out_path, reference_date or "scored")
    return out_path
