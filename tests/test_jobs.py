"""The three batch jobs end to end on the smallest driver tables."""

import pytest
from pyspark.sql import functions as F

from lapse.operators import ml
from lapse.operators import rank as rk
from lapse.plans import jobs
from lapse.sources import commits, readers
from lapse.sources import testviews as tv

SF = "/root/testdata/sf0.001"


def test_feature_training_and_scoring_jobs(spark, tmpdir_path):
    features = jobs.feature_job(spark, tv.members(spark, SF), tv.raw_transactions(spark, SF), tv.user_logs(spark, SF),
                                tv.train(spark, SF), tv.REFERENCE_DATE, tmpdir_path, seq_col="seq", is_synthetic=True)
    ft = readers.read_feature_table(spark, features)
    assert ft.count() == tv.train(spark, SF).count() and len(ft.columns) == 33

    out = jobs.training_job(spark, features, tmpdir_path, trials=1, folds=3,
                            tree_params=ml.TreeParams(max_iter=4, max_depth=3), search_rounds=3)
    m = out["metrics"]
    assert 0.0 <= m["roc_auc"] <= 1.0 and m["tp"] + m["fn"] > 0
    assert spark.read.json(out["thresholds"]).count() == 3
    assert commits.read(spark, out["runs"]).select("run_name").distinct().count() == 2
    cm = spark.read.json(out["confusion"]).first()
    assert cm.threshold == 0.245 and cm.tp + cm.fn == m["tp"] + m["fn"]
    meta = spark.read.json(out["metadata"]).first()
    assert meta.calibration_method == "isotonic, 3 folds" and "total_secs" in meta.features_dropped

    with pytest.raises(ValueError, match="threshold"):
        jobs.scoring_job(spark, features, out["tree_model"], f"{tmpdir_path}/scored")
    scored_path = jobs.scoring_job(spark, features, out["tree_model"], f"{tmpdir_path}/scored",
                                   thresholds_path=out["thresholds"])
    scored = readers.read_feature_table(spark, scored_path)
    assert scored.count() == ft.count()
    assert scored.filter(F.col("churn_probability").isNull()).count() == 0
    assert rk.top_n(scored, 10).count() == 10
    rows = scored.select("risk_tier", "top_drivers", "suggested_action").collect()
    assert all(len(r.top_drivers) == 3 and r.suggested_action == plain_action(r.risk_tier, r.top_drivers) for r in rows)


def plain_action(tier, drivers):
    """The action rule, one row at a time."""
    if tier != "High":
        return {"Low": "No action needed", "Medium": "Send engagement email"}[tier]
    families = (("payment_method_id", "is_cancel", "days_since_last_transaction"), ("days_until_expire", "is_auto_renew"),
                ("plan_list_price", "actual_amount_paid", "payment_plan_days"))
    for d in drivers:
        name, direction = d.rsplit(" ", 1)
        if direction == "(High)":
            for family, action in zip(families, ("Offer alternative payment method", "Proactive renewal outreach", "Offer discount")):
                if name in family:
                    return action
    return "Send targeted retention offer"


def test_model_sees_filled_numbers_and_the_table_keeps_its_nulls(spark):
    seen = []
    df = spark.createDataFrame([("a", 1, None, "x"), ("b", 0, 5, None)], "msno string, is_churn int, days_until_expire int, city string")

    def apply(x):
        seen.extend(x.orderBy("msno").collect())
        return x.withColumn("score", F.col("days_until_expire") * 2.0)

    out = ml.through_model(df, apply).orderBy("msno").collect()
    assert [r.days_until_expire for r in seen] == [0, 5] and [r.city for r in seen] == ["x", None]
    assert [tuple(r) for r in out] == [("a", 1, None, "x", 0.0), ("b", 0, 5, None, 10.0)]


def test_snapshots_of_the_feature_job(spark, tmpdir_path):
    for day in ("2001-01-31", "2001-07-28", "2001-01-31"):
        path = jobs.feature_job(spark, tv.members(spark, SF), tv.raw_transactions(spark, SF), tv.user_logs(spark, SF),
                                tv.train(spark, SF), day, tmpdir_path, seq_col="seq", snapshots=True)
    n = tv.train(spark, SF).count()
    got = readers.read_feature_table(spark, path)
    assert {r[0]: r[1] for r in got.groupBy("reference_date").count().collect()} == {"2001-01-31": n, "2001-07-28": n}
    one = readers.read_feature_table(spark, path, reference_date="2001-01-31")
    assert one.count() == n and commits.entries(spark, path)["2001-01-31"]["meta"]["pipeline_version"] == "0.1.0"
