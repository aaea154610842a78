"""Physical-plan guards for the scale design (checked with explain, not timing)."""

import datetime as dt
import re

import __spark_entry__ as se
from lapse.plans import catalog
from lapse.sources.readers import prepare_transactions

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_products_in_registered_queries(spark):
    bad = []
    for name, q in se.queries().items():
        if name in se.MODEL_FITTING:
            continue
        plan = _plan(q(spark, SF))
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append(name)
    assert bad == []


def test_feature_table_one_exchange_per_join_input(spark):
    """With broadcasts off (as at scale), the three msno joins reuse the
    aggregates' hash partitioning: 8 hash exchanges in total, 3 sort-merge joins."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = _plan(catalog.feature_table(spark, SF))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert plan.count("SortMergeJoin") == 3
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 8
    # one-row totals are scalar subqueries, never a shuffle of the join inputs
    assert "CartesianProduct" not in plan


def test_cutoff_and_pruning_reach_the_parquet_scan(spark, tmpdir_path):
    rows = [("A", 41, 30, 99.0, 99.0, 1, dt.date(2017, 1, d), dt.date(2017, 2, d), 0, d) for d in range(1, 28)]
    df = spark.createDataFrame(rows, "msno string, payment_method_id int, payment_plan_days int, plan_list_price double, "
                                     "actual_amount_paid double, is_auto_renew int, transaction_date date, "
                                     "membership_expire_date date, is_cancel int, seq long")
    df.write.parquet(f"{tmpdir_path}/tx")
    tx = prepare_transactions(spark.read.parquet(f"{tmpdir_path}/tx"), "2017-01-10", seq_col="seq")
    plan = _plan(tx.select("msno", "transaction_date"))
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(transaction_date", plan)
    assert "actual_amount_paid" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert tx.count() == 10
