"""Data faults that must not come back: lost snapshots, columns by position, same-day
renewals, missing or contradicting labels, categories wider than the bins."""

import pytest
from pyspark.sql import functions as F

from lapse.operators import ml, serve
from lapse.operators.labels import agreed_labels, label_churn
from lapse.operators.rank import ranked
from lapse.plans import jobs
from lapse.sources import readers, writers

MEMBERS = "msno,city,bd,gender,registered_via,registration_init_time"


def csv(path, name, *lines):
    with open(f"{path}/{name}.csv", "w") as f:
        f.write("\n".join(lines) + "\n")
    return f"{path}/{name}.csv"


def test_snapshots_accumulate(spark, tmpdir_path):
    for day, n in (("2017-01-31", 3), ("2017-02-28", 5), ("2017-01-31", 4)):
        writers.write_feature_table(spark.range(n).select(F.col("id").cast("string").alias("msno")),
                                    f"{tmpdir_path}/t", day, partitioned=True)
    got = readers.read_feature_table(spark, f"{tmpdir_path}/t").groupBy("reference_date").count().collect()
    assert {str(r[0]): r[1] for r in got} == {"2017-01-31": 4, "2017-02-28": 5}


def test_files_cover_their_own_ids(spark, tmpdir_path):
    frame = spark.range(2000).select(F.format_string("%05d", F.col("id")).alias("msno")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_feature_table(frame, f"{tmpdir_path}/t", None)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = (readers.read_feature_table(spark, f"{tmpdir_path}/t", ["msno"]).groupBy(F.input_file_name())
             .agg(F.min("msno").alias("low"), F.max("msno").alias("high")).orderBy("low").collect())
    assert len(spans) > 1 and all(a.high < b.low for a, b in zip(spans, spans[1:]))


def test_csv_columns_go_by_name(spark, tmpdir_path):
    permuted = csv(tmpdir_path, "p", "city,registration_init_time,msno,extra,bd,gender,registered_via", "1,20170102,a,zzz,25,male,7")
    r = readers.load_members(spark, permuted).first()
    assert (r.msno, r.city, r.bd, str(r.registration_init_time), len(r)) == ("a", 1, 25, "2017-01-02", 6)
    with pytest.raises(ValueError, match="registered_via"):
        readers.load_members(spark, csv(tmpdir_path, "m", "msno,city,bd,gender,registration_init_time", "a,1,2,male,20170101"))


def test_same_day_cancel_and_renewal_is_no_churn(spark):
    rows = [("a", "2017-01-01", "2017-01-31", 0, 99.0), ("a", "2017-02-05", "2017-02-05", 1, 99.0), ("a", "2017-02-05", "2017-03-07", 0, 99.0),
            ("b", "2017-01-01", "2017-01-31", 0, 99.0), ("b", "2017-02-05", "2017-02-05", 1, 99.0),
            ("c", "2017-01-01", "2017-02-20", 0, 99.0), ("c", "2017-01-01", "2017-01-02", 1, 50.0), ("c", "2017-02-10", "2017-03-10", 0, 99.0)]
    tx = spark.createDataFrame(rows, "msno string, d string, e string, is_cancel int, plan_list_price double").select(
        "msno", F.col("d").cast("date").alias("transaction_date"), F.col("e").cast("date").alias("membership_expire_date"),
        "is_cancel", "plan_list_price")
    got = {r.msno: (r.is_churn, r.renewal_gap_days) for r in label_churn(tx, "2017-01-31").collect()}
    assert got == {"a": (0, 5), "b": (1, None), "c": (1, 39)}      # c: the cancel of its last day carries the expiry


def test_labels_must_agree_and_exist(spark):
    fine = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0)], "msno string, is_churn int")
    assert sorted(map(tuple, agreed_labels(fine).collect())) == [("a", 1), ("b", 0)]
    with pytest.raises(Exception, match="conflicting is_churn for msno a"):
        agreed_labels(fine.union(spark.createDataFrame([("a", 0)], fine.schema))).collect()
    with pytest.raises(Exception, match="no is_churn for msno z"):
        ml.stratified_split(fine.union(spark.createDataFrame([("z", None)], fine.schema))).collect()


def test_bins_follow_the_widest_category(spark):
    cats = [c for c in ml.MODEL_FEATURES if c in ml.CATEGORICAL_FEATURES]
    train = spark.range(300).select(*[(F.col("id") % (140 if c == cats[0] else 3)).cast("string").alias(c) for c in cats])
    assert ml.with_bins(ml.TreeParams(), train).max_bins == 141
    assert ml.with_bins(ml.TreeParams(max_bins=500), train).max_bins == 500


def test_feature_job_from_files(spark, tmpdir_path):
    members = csv(tmpdir_path, "members", MEMBERS, "a,1,25,male,7,20160101", "b,2,300,female,9,bad")
    tx = csv(tmpdir_path, "tx", "is_cancel,msno,payment_method_id,payment_plan_days,plan_list_price,actual_amount_paid,is_auto_renew,"
             "transaction_date,membership_expire_date", "0,a,41,30,149,149,1,20170210,20170312", "0,a,41,30,149,149,1,20170401,20170501")
    logs = csv(tmpdir_path, "logs", "msno,date,num_25,num_50,num_75,num_985,num_100,num_unq,total_secs",
               "a,20170227,1,0,0,0,10,9,2500.5", "a,20170305,1,0,0,0,99,9,9999", "b,2017022x,1,0,0,0,99,9,9999")
    labels = csv(tmpdir_path, "labels", "msno,is_churn", "a,0", "b,1")
    path = jobs.feature_job_from_files(spark, members, tx, logs, labels, "2017-02-28", f"{tmpdir_path}/out")
    rows = {r.msno: r for r in readers.read_feature_table(spark, path).collect()}
    assert rows["a"].days_since_last_log == 1 and rows["a"].days_since_last_transaction == 18 and rows["a"].is_churn == 0
    assert rows["b"].days_since_last_log == 999 and rows["b"].age_clean == "Unknown/Invalid" and rows["b"].days_since_registration == -1
    assert spark.read.json(f"{tmpdir_path}/out/customer_features_metadata").first().reference_date == "2017-02-28"


def test_ranks_and_usage_order(spark):
    frame = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate([5, 7, 7, -1, 0])] + [("n", None)], "msno string, expected_value double")
    assert [r.msno for r in sorted(ranked(frame).collect(), key=lambda r: r["rank"])] == ["1", "2", "0", "4", "3", "n"]
    logs = spark.createDataFrame([("a", "2020-01-02", 4.0, 1), ("a", "2020-01-01", 8.0, 1), ("b", "2020-01-01", 0.0, 1)],
                                 "msno string, d string, total_secs double, num_unq int").withColumn("log_date", F.col("d").cast("date"))
    assert sorted((r.msno, r.day_no, r.date) for r in serve.usage_history(logs).collect()) == [
        ("a", 1, "2020-01-01"), ("a", 2, "2020-01-02"), ("b", 1, "2020-01-01")]
    assert sorted((r.msno, r.pct_of_max) for r in serve.usage_share_of_max(logs).collect()) == [("a", 50.0), ("a", 100.0), ("b", 0.0)]


def test_repeated_member_rows_stop_the_job(spark):
    from lapse.operators.features import with_unique_keys
    one = spark.createDataFrame([("a", 1, "male"), ("b", 2, None), (None, 3, "x")], "msno string, city int, gender string")
    assert sorted(map(tuple, with_unique_keys(one, "members").collect()), key=repr) == sorted(map(tuple, one.collect()), key=repr)
    assert with_unique_keys(one, "members").columns == one.columns
    with pytest.raises(Exception, match="members repeat msno a"):
        with_unique_keys(one.union(one.where("msno = 'a'")), "members").collect()
