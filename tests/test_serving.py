"""Serving-query contracts: batch lookup, diversified top-N, cohort stats, samples."""

import pytest
from pyspark.sql import functions as F

from lapse.config import DiversifyQuotas, RiskThresholds
from lapse.operators import cohort as ch
from lapse.operators import rank as rk
from lapse.operators import serve as sv

SCHEMA = ("msno string, churn_probability double, estimated_clv double, expected_value double, "
          "days_since_registration int, payment_plan_days int, risk_tier string, low_confidence boolean")


def _scored(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_batch_lookup_hit_miss_order_and_duplicates(spark):
    scored = _scored(spark, [("A", 0.5, 100.0, 10.0, 100, 30, "High", False)])
    req = sv.batch_requests(spark, ["A", "nope", "A"])
    rows = sv.batch_lookup(req, scored).orderBy("pos").collect()
    assert [r["msno"] for r in rows] == ["A", "nope", "A"]
    assert [r["success"] for r in rows] == [True, False, True]
    assert rows[1]["error_message"] == "Customer not found" and rows[1]["churn_probability"] is None


def test_batch_request_size_validation(spark):
    with pytest.raises(ValueError):
        sv.batch_requests(spark, [])
    with pytest.raises(ValueError):
        sv.batch_requests(spark, [str(i) for i in range(1001)])


def test_diversified_quotas_fillers_and_no_truncation(spark):
    t = RiskThresholds(high=0.5, medium=0.2)
    rows = [(f"h{i}", 0.9, 1000.0, 900.0 - i, 500, 30, "High", False) for i in range(6)]
    rows += [(f"m{i}", 0.3, 1000.0, 200.0 - i, 500, 30, "Medium", False) for i in range(5)]
    rows += [("lo_new", 0.1, 1000.0, -10.0, 20, 30, "Low", False), ("lo_old", 0.1, 1000.0, 50.0, 900, 30, "Low", False)]
    df = _scored(spark, rows)
    got = [r["msno"] for r in rk.diversified_top_n(df, 10, t, DiversifyQuotas()).collect()]
    # 4 High + 3 Medium + 1 new Low = 8 -> 2 fillers by EV (h4, h5)
    assert sorted(got) == sorted(["h0", "h1", "h2", "h3", "m0", "m1", "m2", "lo_new", "h4", "h5"])
    evs = [r["expected_value"] for r in rk.diversified_top_n(df, 10, t, DiversifyQuotas()).collect()]
    assert evs == sorted(evs, reverse=True)
    # quotas exceed n: not truncated
    assert rk.diversified_top_n(df, 3, t, DiversifyQuotas()).count() == 8


def test_cohort_stats_empty_and_shares(spark):
    df = _scored(spark, [("a", 0.9, 1.0, 1.0, 10, 30, "High", True), ("b", 0.01, 1.0, 1.0, 100, 90, "Low", False)])
    r = ch.cohort_stats(df, plan_type=7).first()
    assert r["total_customers"] == 0 and r["churn_rate"] == 0.0 and r["high_share"] == 0.0
    r = ch.cohort_stats(df).first()
    assert r["total_customers"] == 2
    assert abs(r["high_share"] + r["medium_share"] + r["low_share"] - 1.0) < 1e-12
    assert r["risk_tier_distribution"]["High"] == 0.5
    assert ch.cohort_stats(df, tenure="new").first()["total_customers"] == 1
    assert ch.cohort_stats(df, tenure="weird").first()["total_customers"] == 2


def test_segment_cube_has_all_groupings(spark):
    df = _scored(spark, [("a", 0.9, 1.0, 1.0, 10, 30, "High", True), ("b", 0.01, 1.0, 1.0, 100, 90, "Low", False)])
    g = {r["grouping_id"] for r in ch.segment_cube(df).collect()}
    assert g == {0, 1, 2, 3}


def test_seeded_sample_is_partition_independent(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("msno"))
    a = [r[0] for r in sv.seeded_sample(df.repartition(1), 50, 42).collect()]
    b = [r[0] for r in sv.seeded_sample(df.repartition(17), 50, 42).collect()]
    assert a == b and len(set(a)) == 50


def test_search_and_safe_ids(spark):
    df = spark.createDataFrame([("Ab1",), ("xab",), ("a/b",), ("zzz",)], "msno string")
    assert [r[0] for r in sv.search_ids(df, "AB").collect()] == ["Ab1", "xab"]
    assert [r[0] for r in sv.url_safe_ids(df, 10).collect()] == ["Ab1", "xab", "zzz"]


def test_simulate_overrides_only_given_fields(spark):
    base = spark.createDataFrame([("a", 149.0, 30, 0, 500, 0.4)],
                                 "msno string, plan_list_price double, payment_plan_days int, is_auto_renew int, "
                                 "days_since_registration int, churn_probability double")
    scen = spark.createDataFrame([("s1", "a", None, 90, None, None), ("s2", "zz", None, 90, None, None)],
                                 "scenario_id string, msno string, plan_list_price double, payment_plan_days int, "
                                 "is_auto_renew int, days_since_registration int")
    out = sv.simulate(scen, base, lambda d: d.withColumn("churn_probability", F.lit(0.4))).collect()
    assert len(out) == 1
    r = out[0]
    assert r["payment_plan_days"] == 90 and r["plan_list_price"] == 149.0
    assert abs(r["estimated_clv"] - 149.0 * 30 / 90 * 20) < 1e-9
