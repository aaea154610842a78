"""Profiles, sinks and cross-partitioning invariants."""

import datetime as dt
import glob
import json

from pyspark.sql import functions as F

from lapse.operators import profile as pf
from lapse.sources import commits, writers


def test_monthly_counts_fill_empty_months(spark):
    df = spark.createDataFrame([(dt.date(2017, 1, 5),), (dt.date(2017, 1, 9),), (dt.date(2017, 4, 1),), (None,)],
                               "d date")
    got = [(r["month"], r["n"]) for r in pf.monthly_counts(df, "d").orderBy("month").collect()]
    assert got == [(dt.date(2017, 1, 1), 2), (dt.date(2017, 2, 1), 0), (dt.date(2017, 3, 1), 0),
                   (dt.date(2017, 4, 1), 1)]


def test_duplicates_and_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None)], "k string, v int")
    assert pf.duplicate_count(df, ["k", "v"]).first()[0] == 1
    nulls = {r["column"]: r["null_pct"] for r in pf.null_percent(df).collect()}
    assert nulls == {"k": 0.0, "v": 25.0}


def test_key_coverage_absent_id(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("ghost",)], "msno string")
    other = spark.createDataFrame([("a",), ("a",), ("b",)], "msno string")
    r = pf.key_coverage(ids, {"t": other}).first()
    assert r["found"] == 2 and abs(r["coverage_pct"] - 200 / 3) < 1e-9


def test_sinks_roundtrip(spark, tmpdir_path):
    from lapse.plans import catalog
    ft = catalog.feature_table(spark, "/root/testdata/sf0.001")
    writers.write_feature_table(ft, f"{tmpdir_path}/ft", "2001-07-28", partitioned=True)
    back = spark.read.parquet(f"{tmpdir_path}/ft")
    assert back.count() == ft.count() and "reference_date" in back.columns
    writers.write_metadata(spark, f"{tmpdir_path}/meta", "2001-07-28", is_synthetic=True)
    meta = json.loads(open(glob.glob(f"{tmpdir_path}/meta/part-*.json")[0]).readline())
    assert meta["reference_date"] == "2001-07-28" and meta["is_synthetic"] is True
    run = writers.log_run(spark, f"{tmpdir_path}/runs", "baseline", {"max_iter": 1000}, {"pr_auc": 0.5})
    log = commits.read(spark, f"{tmpdir_path}/runs", [run])
    assert log.count() == 2
    writers.log_run(spark, f"{tmpdir_path}/runs", "other", {"a": 1})
    writers.log_run(spark, f"{tmpdir_path}/runs", "baseline", {"max_iter": 7}, run_id=run)     # the same run again
    rows = commits.read(spark, f"{tmpdir_path}/runs").collect()
    assert sorted((r.run_name, r.name, r.value) for r in rows) == [("baseline", "max_iter", "7"), ("other", "a", "1")]


def test_queries_stable_under_repartitioning(spark):
    """Same result under 1 and 64 shuffle partitions (no dependence on layout)."""
    from lapse.plans import catalog
    sf = "/root/testdata/sf0.001"
    names = ["customer_feature_table", "churn_labels", "diversified_actions", "roc_curve", "train_test_split"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = {n: catalog.QUERIES[n](spark, sf).collect() for n in names}
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        b = {n: catalog.QUERIES[n](spark, sf).collect() for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for n in names:
        assert sorted(map(tuple, a[n]), key=repr) == sorted(map(tuple, b[n]), key=repr), n


def test_members_csv_scan_and_base_cohort(spark, tmpdir_path):
    from lapse.sources import readers
    p = f"{tmpdir_path}/members.csv"
    with open(p, "w") as f:
        f.write("msno,city,bd,gender,registered_via,registration_init_time\n"
                "A,1,25,male,7,20150101\nB,3,0,,9,2015013x\n")
    m = {r["msno"]: r for r in readers.load_members(spark, p).collect()}
    assert m["A"]["registration_init_time"] == dt.date(2015, 1, 1)
    assert m["B"]["registration_init_time"] is None and m["B"]["gender"] is None
    labels = spark.createDataFrame([("A", 1), ("A", 1), ("B", 0)], "msno string, is_churn int")
    assert readers.base_cohort(labels).count() == 2
    assert readers.base_cohort(spark=spark, msno_list=["x", "x"]).count() == 2


def test_threshold_and_curve_sinks(spark, tmpdir_path):
    from lapse.operators import evaluate as ev
    df = spark.range(1, 201).select((F.col("id") / 200.0).alias("churn_probability"),
                                    (F.col("id") % 3 == 0).cast("int").alias("is_churn"))
    writers.write_thresholds(ev.tier_thresholds(df), f"{tmpdir_path}/thr")
    assert spark.read.json(f"{tmpdir_path}/thr").count() == 3
    writers.write_curves({"roc": (ev.roc_curve(df).select("tpr", "fpr", "idx", "j"), "j", "fpr", "tpr"),
                          "pr": (ev.pr_curve(df), "j", "precision", "recall"),
                          "calibration": (ev.calibration_curve(df), "bin", "prob_pred", "prob_true")}, f"{tmpdir_path}/curves")
    back = spark.read.parquet(f"{tmpdir_path}/curves")
    counts = {r["curve"]: r["count"] for r in back.groupBy("curve").count().collect()}
    assert counts["roc"] == 100 and counts["pr"] == 100 and counts["calibration"] == 10
    want = {(r.j, r.fpr, r.tpr) for r in ev.roc_curve(df).collect()}
    assert {(r.j, r.x, r.y) for r in back.filter("curve = 'roc'").collect()} == want      # by name, whatever the order
    writers.write_confusion(ev.confusion(df, 0.245), 0.245, f"{tmpdir_path}/cm")
    cm = spark.read.json(f"{tmpdir_path}/cm").first()
    assert cm.threshold == 0.245 and cm.tn + cm.fp + cm.fn + cm.tp == 200 and cm.tp + cm.fn == 66


def test_date_text_helpers(spark):
    from lapse.functions.dates import iso_date_text, parse_yyyymmdd
    df = spark.createDataFrame([("20170105",), ("2017-01-05",), ("bad",)], "s string")
    assert [r[0] for r in df.select(iso_date_text("s")).collect()] == ["2017-01-05", "2017-01-05", "bad"]
    assert [r[0] for r in df.select(parse_yyyymmdd("s")).collect()] == [dt.date(2017, 1, 5), None, None]
