"""As-of joins, labels at many cutoffs, snapshots and monthly states against plain Python,
with one customer holding a third of all rows."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from lapse.config import FeatureConfig
from lapse.operators import asof, labels, logs, serve, snapshots, transactions
from lapse.operators.features import build_engagement_features

TX = ("msno string, transaction_date date, membership_expire_date date, is_cancel int, plan_list_price double, payment_plan_days int, "
      "is_auto_renew int, payment_method_id int, seq long")


def day(n):
    return dt.date(2016, 1, 1) + dt.timedelta(days=n)


def transactions_of(spark, n=900, seed=1, unique_days=False):
    """A third of the rows is customer 'hot'; some dates, prices and expiries are missing."""
    rng, rows, seen = random.Random(seed), [], set()
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"c{rng.randint(0, 40)}"
        d = None if rng.random() < 0.02 else day(rng.randint(0, 700))
        if unique_days:
            if (key, d) in seen:
                continue
            seen.add((key, d))
        expire = None if rng.random() < 0.03 or d is None else d + dt.timedelta(days=rng.randint(-5, 60))
        rows.append((key, d, expire, int(rng.random() < 0.2), rng.choice([99.0, 129.0, 149.0, None]), rng.choice([7, 30]), rng.randint(0, 1),
                     rng.choice([1, 2, 3, None]), i))
    return spark.createDataFrame(rows, TX).repartition(7), rows


def test_asof_join_both_ways(spark):
    rng = random.Random(5)
    right = [(rng.choice(["a", "b", "hot", "hot", None]), None if rng.random() < 0.05 else day(rng.randint(0, 200)), i, rng.choice([None, 1.5, 2.5]))
             for i in range(400)]
    left = [(rng.choice(["a", "b", "hot", "nobody", None]), None if rng.random() < 0.05 else day(rng.randint(-20, 220)), i) for i in range(300)]
    left += [left[5]] * 3
    r = spark.createDataFrame(right, "id string, at date, v int, w double")
    q = spark.createDataFrame(left, "id string, when date, n int")
    for direction in ("backward", "forward"):
        got = asof.asof_join(q, r.withColumnRenamed("at", "then"), "id", "when", "then", ["v", "w"], [F.col("v")], direction).collect()
        want = []
        for key, when, n in left:
            fit = [x for x in right if key is not None and when is not None and x[0] == key and x[1] is not None
                   and (x[1] <= when if direction == "backward" else x[1] > when)]
            best = (max(fit, key=lambda x: (x[1], x[2])) if direction == "backward" else min(fit, key=lambda x: (x[1], -x[2]))) if fit else None
            want.append((key, when, n, *((best[2], best[3]) if best else (None, None))))
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError, match="direction"):
        asof.asof_join(q, r, "id", "when", "at", ["v"], direction="nearest")


def test_labels_at_many_cutoffs_equal_one_at_a_time(spark):
    tx, _ = transactions_of(spark)
    cutoffs = [day(n) for n in (-5, 0, 30, 31, 200, 500, 699, 700, 900)]
    many = labels.label_churn_at_all(tx, cutoffs, 30, seq_col="seq").collect()
    own = spark.createDataFrame([(f"c{i % 40}" if i % 4 else "hot", c) for i in range(80) for c in cutoffs], "msno string, cutoff_date date")
    asked = labels.label_churn_asof(tx, own, 30, seq_col="seq").collect()
    for c in cutoffs:
        single = {r.msno: tuple(r)[1:] for r in labels.label_churn(tx, c, 30, seq_col="seq").collect()}
        assert {r.msno: tuple(r)[2:] for r in many if r.cutoff_date == c} == single
        mine = {r.msno: tuple(r)[2:] for r in asked if r.cutoff_date == c}
        wanted = {r.msno for r in own.where(F.col("cutoff_date") == F.lit(c)).collect()}
        assert mine == {k: v for k, v in single.items() if k in wanted}
    assert len(many) == len({(r.msno, r.cutoff_date) for r in many})
    with pytest.raises(ValueError):
        labels.label_churn_at_all(tx, [])


def test_many_cutoffs_read_the_table_once(spark, tmpdir_path):
    tx, _ = transactions_of(spark)
    tx.write.parquet(f"{tmpdir_path}/tx")
    out = labels.label_churn_at_all(spark.read.parquet(f"{tmpdir_path}/tx"), [day(n) for n in range(0, 700, 30)], seq_col="seq")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) == 1 and plan.count("Exchange hashpartitioning") <= 2


def test_snapshots_equal_single_dates(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"c{rng.randint(0, 30)}", None if rng.random() < 0.02 else day(rng.randint(0, 150)), rng.randint(0, 9), rng.randint(0, 5),
             float(rng.randint(0, 10_000)) / 8) for i in range(700)]
    log = spark.createDataFrame(rows, "msno string, log_date date, num_100 int, num_unq int, total_secs double")
    states = snapshots.daily_states(log)
    half = F.col("log_date") < F.lit(day(60))
    merged = snapshots.merge_states(snapshots.daily_states(log.where(half)), snapshots.daily_states(log.where(~half).limit(100)),
                                    snapshots.daily_states(log.where(~half).subtract(log.where(~half).limit(100))))
    dates = [day(n) for n in (-3, 0, 15, 45, 46, 90, 149, 150, 179, 181, 400)]
    base = spark.createDataFrame([("hot",), ("c1",), ("nobody",)], "msno string")
    for cfg in (FeatureConfig(), FeatureConfig(windows_days=(3, 50), unq_windows=(50,), trend_window_recent=5, trend_window_prior=9)):
        got = snapshots.aggregate_snapshots(states, dates, cfg)
        columns = [c for c in got.columns if c != "reference_date"]
        rows_got = got.collect()
        feats = snapshots.engagement_snapshots(states, base, dates, cfg).collect()
        for d in dates:
            single = logs.aggregate_logs(log, d, cfg)
            want = {r.msno: tuple(r[c] for c in columns) for r in single.collect()}
            assert {r.msno: tuple(r[c] for c in columns) for r in rows_got if r.reference_date == d} == want
            f = build_engagement_features(single, base, cfg)
            assert sorted(tuple(r[c] for c in f.columns) for r in feats if r.reference_date == d) == sorted(map(tuple, f.collect()))
    a, b = ({(r.msno, r.log_date): tuple(r)[2:] for r in t.collect()} for t in (states, merged))
    assert set(a) == set(b)


def test_merged_months_equal_whole_histories(spark):
    tx, rows = transactions_of(spark, unique_days=True)
    got = {r.msno: r for r in transactions.merged_history(transactions.monthly_states(tx)).collect()}
    assert {k: tuple(r) for k, r in got.items()} == {r.msno: tuple(r) for r in transactions.transaction_history(tx).collect()}
    late = dt.date(9999, 1, 1)
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1] or late)
        g = got[key]
        changes = sum(not (a[4] is not None and a[4] == b[4]) for a, b in zip(own, own[1:]))
        assert (g.num_plan_changes, g.num_payment_methods, g.num_cancellations) == (
            changes, len({r[7] for r in own if r[7] is not None}), sum(r[3] for r in own))
        last = own[-1]
        assert (g.last_plan_list_price, g.last_payment_plan_days, g.last_payment_method_id, g.last_transaction_date) == (last[4], last[5], last[7], last[1])
        assert g.max_expire_date == max((r[2] for r in own if r[2]), default=None)


def test_no_window_holds_a_whole_customer(spark):
    """The hot customer's rows are numbered and flagged by month, in the plans as well."""
    tx, _ = transactions_of(spark, unique_days=True)
    months = transactions.monthly_states(tx)
    assert months.where("msno = 'hot'").count() > 20
    plan = months._jdf.queryExecution().executedPlan().toString()
    assert all("_month" in w for w in re.findall(r"Window \[.*", plan)) and "_month" in plan
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"c{i % 7}", None if i % 50 == 0 else day(rng.randint(0, 300)), float(i), i) for i in range(400)]
    log = spark.createDataFrame(rows, "msno string, log_date date, total_secs double, num_unq int")
    got = {(r.msno, r.total_secs): (r.day_no, r.date) for r in serve.usage_history(log).collect()}
    assert len(got) == 400
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] or dt.date(1, 1, 1), r[2], r[3]))
        for n, r in enumerate(own, 1):
            assert got[(key, r[2])] == (n, r[1].isoformat() if r[1] else None)
