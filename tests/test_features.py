"""Feature-family unit cases (literal rows from FIXTURES.md section 1) plus edges."""

import datetime as dt

from pyspark.sql import functions as F

from lapse.config import FeatureConfig
from lapse.operators import features as fb
from lapse.operators.dedup import dedup_same_day
from lapse.operators.logs import aggregate_logs
from lapse.sources import readers

TX_HEADER = ("msno,payment_method_id,payment_plan_days,plan_list_price,actual_amount_paid,is_auto_renew,"
             "transaction_date,membership_expire_date,is_cancel\n")


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_missing_customer_in_logs_gets_sentinels(spark):
    base = spark.createDataFrame([("A",), ("B",)], "msno string")
    agg = spark.createDataFrame(
        [("A", 2, 5, 10.5, 5000.0, 4000.0, 20.0, 15.0)],
        "msno string, days_since_last_log int, active_days_7 long, avg_songs_100_7 double, "
        "recent_avg_secs double, prior_avg_secs double, recent_avg_songs double, prior_avg_songs double")
    cfg = FeatureConfig(windows_days=(7,), unq_windows=())
    # only the columns present in the literal aggregate are exercised
    for c in ("avg_secs_7",):
        agg = agg.withColumn(c, F.lit(None).cast("double"))
    res = {r["msno"]: r for r in fb.build_engagement_features(agg, base, cfg).collect()}
    assert res["B"]["active_days_7"] == 0
    assert res["B"]["days_since_last_log"] == 999
    assert res["B"]["engagement_trend_secs_ratio"] == 0
    assert abs(res["A"]["engagement_trend_secs_ratio"] - 5000 / (4000 + 1e-5)) < 1e-9


def test_same_day_duplicates_resolve_to_one_row(spark, tmpdir_path):
    p = _write(f"{tmpdir_path}/tx.csv", TX_HEADER + "A,41,30,99,99,1,20170101,20170201,0\n"
                                                     "A,41,30,149,149,1,20170101,20170201,1\n")
    rows = readers.load_transactions(spark, p, reference_date="2017-02-01").collect()
    assert len(rows) == 1
    assert rows[0]["is_cancel"] == 1 and rows[0]["plan_list_price"] == 149


def test_dedup_null_priority_wins_and_seq_breaks_ties(spark):
    df = spark.createDataFrame(
        [("A", dt.date(2017, 1, 1), 0, 99.0, 1), ("A", dt.date(2017, 1, 1), None, 10.0, 2),
         ("B", dt.date(2017, 1, 1), 0, 99.0, 1), ("B", dt.date(2017, 1, 1), 0, 99.0, 7)],
        "msno string, transaction_date date, is_cancel int, plan_list_price double, seq long")
    out = {r["msno"]: r for r in dedup_same_day(df, seq_col="seq").collect()}
    assert out["A"]["is_cancel"] is None
    assert out["B"]["seq"] == 7


def test_age_bucketing(spark):
    base = spark.createDataFrame([(m,) for m in "ABCD"], "msno string")
    members = spark.createDataFrame(
        [("A", 1, -5, "male", 7, dt.date(2015, 1, 1)), ("B", 1, 25, "female", 7, dt.date(2015, 1, 1)),
         ("C", 1, 105, None, 7, dt.date(2015, 1, 1)), ("D", 1, None, "male", 9, dt.date(2015, 1, 1))],
        "msno string, city int, bd int, gender string, registered_via int, registration_init_time date")
    res = {r["msno"]: r for r in fb.build_demographic_features(members, base).collect()}
    assert res["A"]["age_clean"] == "Unknown/Invalid"
    assert res["B"]["age_clean"] == "25"
    assert res["C"]["age_clean"] == "Unknown/Invalid"
    assert res["D"]["age_clean"] == "Unknown/Invalid"
    assert res["C"]["gender"] == "Unknown"
    assert res["A"]["city"] == "1"


def test_rare_registration_channel_rolls_up(spark):
    rows = [(str(i), 1, 30, "male", 7, dt.date(2015, 1, 1)) for i in range(200)]
    rows.append(("rare", 1, 30, "male", 13, dt.date(2015, 1, 1)))      # 1 / 201 < 1 %
    rows.append(("none", 1, 30, "male", None, dt.date(2015, 1, 1)))
    members = spark.createDataFrame(rows, "msno string, city int, bd int, gender string, registered_via int, "
                                          "registration_init_time date")
    base = spark.createDataFrame([("rare",), ("none",), ("0",), ("ghost",)], "msno string")
    res = {r["msno"]: r["registered_via_clean"] for r in fb.build_demographic_features(members, base).collect()}
    assert res == {"rare": "Other", "none": "Unknown", "0": "7", "ghost": "Unknown"}


def test_reference_date_shifting(spark, tmpdir_path):
    p = _write(f"{tmpdir_path}/tx.csv", TX_HEADER + "A,41,30,99,99,1,20170101,20170201,0\n"
                                                     "A,41,30,149,149,1,20170301,20170401,0\n")
    base = spark.createDataFrame([("A",)], "msno string")
    early = readers.load_transactions(spark, p, reference_date="2017-02-01")
    assert early.count() == 1
    assert early.first()["transaction_date"] == dt.date(2017, 1, 1)
    f_early = fb.build_transaction_features(early, base, "2017-02-01").first()
    assert f_early["days_since_last_transaction"] == 31
    late = readers.load_transactions(spark, p, reference_date="2017-04-01")
    assert late.count() == 2
    f_late = fb.build_transaction_features(late, base, "2017-04-01").first()
    assert f_late["days_since_last_transaction"] == 31
    assert f_late["num_plan_changes"] == 1


def test_unparseable_dates_become_null_and_drop_at_cutoff(spark, tmpdir_path):
    p = _write(f"{tmpdir_path}/tx.csv", TX_HEADER + "A,41,30,99,99,1,2017010x,20170201,0\n"
                                                     "A,41,30,99,99,1,20170230,20170201,0\n"
                                                     "A,41,30,99,99,1,20170105,20170205,0\n")
    assert readers.load_transactions(spark, p, reference_date="2017-02-01").count() == 1
    # without a reference date the undated rows stay (two NULL days dedup to one)
    assert readers.load_transactions(spark, p).count() == 2


def test_plan_changes_null_price_counts_and_single_row_is_zero(spark):
    d = dt.date
    tx = spark.createDataFrame(
        [("A", d(2017, 1, 1), 99.0), ("A", d(2017, 2, 1), None), ("A", d(2017, 3, 1), None),
         ("A", d(2017, 4, 1), 149.0), ("A", d(2017, 5, 1), 149.0), ("S", d(2017, 1, 1), 99.0)],
        "msno string, transaction_date date, plan_list_price double")
    tx = tx.withColumns({"payment_plan_days": F.lit(30), "is_auto_renew": F.lit(1), "payment_method_id": F.lit(41),
                         "is_cancel": F.lit(0), "membership_expire_date": F.date_add("transaction_date", 30)})
    base = spark.createDataFrame([("A",), ("S",), ("Z",)], "msno string")
    res = {r["msno"]: r for r in fb.build_transaction_features(tx, base, "2017-06-01").collect()}
    # 99->null, null->null, null->149 count; 149->149 does not
    assert res["A"]["num_plan_changes"] == 3
    assert res["S"]["num_plan_changes"] == 0
    assert res["Z"]["num_plan_changes"] == 0 and res["Z"]["days_since_last_transaction"] == -1
    assert res["Z"]["payment_method_id"] == "Unknown"


def test_window_edges_are_inclusive(spark):
    ref = dt.date(2017, 3, 31)
    days = [7, 8, 14, 15, 28, 29, 30, 31]
    logs = spark.createDataFrame([("A", ref - dt.timedelta(days=k), 10, 2, 100.0) for k in days] +
                                 [("A", ref + dt.timedelta(days=1), 99, 9, 9999.0)],
                                 "msno string, log_date date, num_100 int, num_unq int, total_secs double")
    r = aggregate_logs(logs, ref).first()
    assert r["days_since_last_log"] == 7
    assert r["active_days_7"] == 1       # day 7 only (day 8 outside)
    assert r["active_days_14"] == 3      # 7, 8, 14
    assert r["active_days_30"] == 7      # all but 31
    assert r["recent_avg_secs"] == 100.0
    assert r["prior_avg_secs"] == 100.0  # 15, 28 in (14, 28]
    empty = aggregate_logs(logs.filter(F.col("log_date") < ref - dt.timedelta(days=20)), ref).first()
    assert empty["avg_secs_7"] is None and empty["active_days_7"] == 0


def test_feature_table_one_row_per_base_id_and_full_width(spark):
    from lapse.plans import catalog
    df = catalog.feature_table(spark, "/root/testdata/sf0.001")
    assert len(df.columns) == 33
    n, distinct = df.agg(F.count("*"), F.countDistinct("msno")).first()
    assert n == distinct and n > 0


def test_feature_table_ignores_facts_after_reference(spark):
    """Facts dated after the reference date must not change any feature."""
    from lapse.plans import catalog
    from lapse.sources import testviews as tv
    sf = "/root/testdata/sf0.001"
    train = tv.train(spark, sf)
    tx_all = tv.raw_transactions(spark, sf)
    logs = tv.user_logs(spark, sf)
    ref = tv.REFERENCE_DATE
    a = fb.build_customer_feature_table(tv.members(spark, sf), readers.prepare_transactions(tx_all, ref, "seq"),
                                        logs, train, ref)
    trimmed = tx_all.filter(F.col("transaction_date") <= ref)
    b = fb.build_customer_feature_table(tv.members(spark, sf), readers.prepare_transactions(trimmed, ref, "seq"),
                                        logs.filter(F.col("log_date") <= ref), train, ref)
    a, b = [d.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes]) for d in (a, b)]
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert catalog.feature_table(spark, sf).count() == a.count()


def test_cohort_of_some_ids_matches_full_table(spark):
    from lapse.sources import testviews as tv
    sf = "/root/testdata/sf0.001"
    ref = tv.REFERENCE_DATE
    args = (tv.members(spark, sf), tv.transactions(spark, sf), tv.user_logs(spark, sf))
    full = fb.build_customer_feature_table(*args, tv.train(spark, sf), ref)
    ids = [r[0] for r in full.select("msno").orderBy("msno").limit(3).collect()] + ["not-a-customer"]
    base = readers.base_cohort(spark=spark, msno_list=ids)
    def rounded(df):   # sums of doubles in a different order differ in the last bits
        return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    small = rounded(fb.build_customer_feature_table(*args, base, ref))
    assert small.count() == 4
    expect = rounded(full.filter(F.col("msno").isin(ids)).drop("is_churn"))
    assert small.filter(F.col("msno") != "not-a-customer").exceptAll(expect).count() == 0
    ghost = small.filter(F.col("msno") == "not-a-customer").first()
    assert ghost["days_since_last_log"] == 999 and ghost["city"] == "Unknown"
