"""Business-value, tier, ranking and action-rule cases (FIXTURES.md section 1)."""

from pyspark.sql import functions as F

from lapse import config as C
from lapse.config import BusinessConfig, RiskThresholds
from lapse.operators import attribute as at
from lapse.operators import rank as rk
from lapse.operators.value import estimated_clv, expected_value, low_confidence, risk_tier, score_customers

CFG = BusinessConfig(avg_customer_lifespan_months=20, discount_cost_percentage=0.05,
                     retention_success_rate=0.3, default_monthly_revenue=149)


def test_clv_plan_price_and_fallback(spark):
    df = spark.createDataFrame([(149.0, 30), (None, 0), (99.0, None), (120.0, -5)],
                               "plan_list_price double, payment_plan_days int")
    got = [r[0] for r in df.select(estimated_clv(CFG)).collect()]
    assert got == [2980.0, 2980.0, 2980.0, 2980.0]


def test_expected_value_positive_and_negative(spark):
    df = spark.createDataFrame([(0.8, 3000.0), (0.1, 3000.0)], "churn_probability double, estimated_clv double")
    got = [r[0] for r in df.select(expected_value(cfg=CFG)).collect()]
    assert abs(got[0] - 570.0) < 1e-9
    assert got[1] < 0 and abs(got[1] + 60.0) < 1e-9


def test_ranking_by_expected_value(spark):
    df = spark.createDataFrame([("A", 0.9, 99.0, 30, 1980.0), ("B", 0.6, 300.0, 30, 6000.0),
                                ("C", 0.05, 149.0, 30, 2980.0)],
                               "msno string, churn_probability double, plan_list_price double, "
                               "payment_plan_days int, estimated_clv double")
    rows = rk.prioritized_action_list(df, CFG).collect()
    assert [r["msno"] for r in rows] == ["B", "A", "C"]
    ev = {r["msno"]: r["expected_value"] for r in rows}
    assert abs(ev["A"] - 435.6) < 1e-9 and abs(ev["B"] - 780.0) < 1e-9 and ev["C"] < 0


def test_equal_ev_ties_break_on_id(spark):
    df = spark.createDataFrame([("b", 0.5, 1000.0), ("a", 0.5, 1000.0), ("c", 0.9, 1000.0)],
                               "msno string, churn_probability double, estimated_clv double")
    rows = rk.top_n(rk.with_value(df, CFG), 2).collect()
    assert [r["msno"] for r in rows] == ["c", "a"]


def test_reprice_is_pure(spark):
    base = BusinessConfig()
    df = spark.createDataFrame([("a", 0.5, 1000.0, 0.0)],
                               "msno string, churn_probability double, estimated_clv double, expected_value double")
    out = rk.reprice(df, base, discount_cost=0.1, retention_rate=0.5).first()["expected_value"]
    assert abs(out - (0.5 * 0.5 * 1000 - 0.1 * 1000)) < 1e-9
    assert base.discount_cost_percentage == 0.05 and base.retention_success_rate == 0.3


def test_tier_cutoffs_inclusive(spark):
    t = RiskThresholds(high=0.2533, medium=0.1687)
    df = spark.createDataFrame([(0.2533,), (0.2532999,), (0.1687,), (0.1686999,)], "churn_probability double")
    assert [r[0] for r in df.select(risk_tier(t=t)).collect()] == ["High", "Medium", "Medium", "Low"]


def test_low_confidence_flag(spark):
    df = spark.createDataFrame([(None,), (-1,), (13,), (14,)], "days_since_registration int")
    assert [r[0] for r in df.select(low_confidence()).collect()] == [True, True, True, False]


def test_action_rule_cases(spark):
    rows = [
        ("Low", None),
        ("Medium", ["active_days_7 (High)"]),
        ("High", ["payment_method_id (High)", "age (High)"]),
        ("High", ["plan_list_price (High)"]),
        ("High", ["days_until_expire (High)"]),
        ("High", None),
        ("High", ["plan_list_price (Low)", "is_auto_renew (High)"]),
        ("High", ["age_clean (High)"]),
    ]
    df = spark.createDataFrame(rows, "tier string, drivers array<string>")
    got = [r[0] for r in df.select(at.retention_action_from_text(F.col("tier"), F.col("drivers"))).collect()]
    assert got == [C.ACTION_LOW, C.ACTION_MEDIUM, C.ACTION_PAYMENT, C.ACTION_DISCOUNT, C.ACTION_RENEWAL,
                   C.ACTION_FALLBACK_HIGH, C.ACTION_RENEWAL, C.ACTION_FALLBACK_HIGH]


def test_top_drivers_order_and_text(spark):
    df = spark.createDataFrame([("a", 0.1, -0.5, 0.3, 0.5)], "msno string, f1 double, f2 double, f3 double, f4 double")
    contrib = at.standin_contributions(df, {"f1": 1.0, "f2": 1.0, "f3": 1.0, "f4": 1.0})
    d = at.top_drivers(F.col("contributions"), 3)
    texts = contrib.select(at.driver_strings(d)).first()[0]
    assert texts == ["f2 (Low)", "f4 (High)", "f3 (High)"]


def test_score_customers_columns(spark):
    df = spark.createDataFrame([("a", 0.3, 149.0, 30, 5)],
                               "msno string, churn_probability double, plan_list_price double, "
                               "payment_plan_days int, days_since_registration int")
    r = score_customers(df, CFG).first()
    assert r["risk_tier"] == "High" and r["estimated_clv"] == 2980.0 and r["low_confidence"] is True
    assert abs(r["expected_value"] - (0.3 * 0.3 * 2980 - 0.05 * 2980)) < 1e-9
