"""Distributed evaluation operators against brute-force numpy on small fixtures."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapse.operators import evaluate as ev
from lapse.operators.cumulative import running_totals


def _fixture(spark, n=400, seed=7):
    rng = np.random.default_rng(seed)
    p = np.round(rng.random(n), 2)            # many ties
    y = (rng.random(n) < p).astype(int)
    y[:3] = [0, 1, 1]
    pdf = [(f"c{i}", float(p[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(pdf, "msno string, churn_probability double, is_churn int"), p, y


def _brute_curve(p, y):
    order = np.argsort(-p, kind="mergesort")
    ps, ys = p[order], y[order]
    distinct = np.r_[np.where(np.diff(ps))[0], len(ps) - 1]
    tps = np.cumsum(ys)[distinct]
    fps = (1 + distinct) - tps
    return ps[distinct], tps, fps


def test_running_totals_match_cumsum_with_many_buckets(spark):
    rng = np.random.default_rng(3)
    vals = rng.permutation(1000).astype(float)
    w = rng.integers(1, 5, 1000)
    df = spark.createDataFrame([(float(v), int(x)) for v, x in zip(vals, w)], "v double, w long")
    for desc in (False, True):
        out = running_totals(df, "v", ["w"], descending=desc, buckets=7).toPandas().sort_values("v", ascending=not desc)
        expect = np.cumsum(out["w"].to_numpy())
        assert (out["cum_w"].to_numpy() == expect).all()


def test_running_totals_by_group(spark):
    df = spark.createDataFrame([(g, float(i), 1) for g in ("a", "b") for i in range(50)], "g string, v double, one int")
    out = running_totals(df, "v", ["one"], by=["g"], buckets=5).toPandas()
    for _, part in out.groupby("g"):
        part = part.sort_values("v")
        assert list(part["cum_one"]) == list(range(1, 51))


def test_group_ranges_never_shuffle_a_group_into_one_task(spark):
    df = spark.range(2000).selectExpr("id % 2 AS g", "CAST(id AS DOUBLE) AS v", "1 AS one")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")        # as on tables too large to broadcast
    try:
        plan = running_totals(df, "v", ["one"], by=["g"], buckets=5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"SortMergeJoin \[g#\d+L?\], ", plan), plan


def test_roc_auc_and_average_precision_brute_force(spark):
    df, p, y = _fixture(spark)
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    _, tps, fps = _brute_curve(p, y)
    prec, rec = tps / (tps + fps), tps / tps[-1]
    ap = np.sum(np.diff(np.r_[0, rec]) * prec)
    assert abs(ev.roc_auc(df).first()[0] - auc) < 1e-12
    assert abs(ev.average_precision(df).first()[0] - ap) < 1e-12


def test_curves_thinned_like_linspace(spark):
    df, p, y = _fixture(spark)
    _, tps, fps = _brute_curve(p, y)
    fpr = np.r_[0, fps / fps[-1]]
    tpr = np.r_[0, tps / tps[-1]]
    idx = np.linspace(0, len(fpr) - 1, 100).astype(int)
    got = ev.roc_curve(df, 100).orderBy("j").toPandas()
    assert np.allclose(got["fpr"], fpr[idx]) and np.allclose(got["tpr"], tpr[idx])
    prec = np.r_[(tps / (tps + fps))[::-1], 1]
    rec = np.r_[(tps / tps[-1])[::-1], 0]
    idx = np.linspace(0, len(prec) - 1, 100).astype(int)
    got = ev.pr_curve(df, 100).orderBy("j").toPandas()
    assert np.allclose(got["precision"], prec[idx]) and np.allclose(got["recall"], rec[idx])


def test_confusion_and_brier(spark):
    df, p, y = _fixture(spark)
    pred = p >= 0.5
    r = ev.confusion(df, 0.5).first()
    tp, fp, fn = int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum()), int((~pred & (y == 1)).sum())
    assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, fn)
    assert abs(r["f1_score"] - 2 * tp / (2 * tp + fp + fn)) < 1e-12
    assert abs(r["brier_score"] - np.mean((p - y) ** 2)) < 1e-12


def test_calibration_bins_edge_falls_left(spark):
    df = spark.createDataFrame([(0.1, 1), (0.1000001, 0), (0.3, 1), (1.0, 1)], "churn_probability double, is_churn int")
    got = {r["bin"]: r["n"] for r in ev.calibration_curve(df, 10).collect()}
    edges = np.linspace(0, 1, 11)[1:-1]
    expect = {}
    for v in (0.1, 0.1000001, 0.3, 1.0):
        b = int(np.searchsorted(edges, v))
        expect[b] = expect.get(b, 0) + 1
    assert got == expect


@pytest.mark.parametrize("qs", [[0.95, 0.85], [0.0, 0.5, 1.0]])
def test_exact_percentiles_match_numpy(spark, qs):
    df, p, _ = _fixture(spark)
    row = ev.exact_percentiles(df, "churn_probability", qs, buckets=9).first()
    for q, v in zip(qs, row):
        assert abs(v - np.percentile(p, q * 100)) < 1e-12


def test_histogram_matches_numpy(spark):
    df, p, _ = _fixture(spark)
    counts, edges = np.histogram(p, bins=50)
    got = ev.score_histogram(df, "churn_probability", 50).orderBy("bin").toPandas()
    assert list(got["n"]) == list(counts)
    assert np.allclose(got["bin_lo"], edges[:-1])


def test_tier_thresholds_table(spark):
    df = spark.range(1, 101).select((F.col("id") / 100.0).alias("churn_probability"))
    t = {r["tier"]: r for r in ev.tier_thresholds(df).collect()}
    assert abs(t["High"]["min_prob"] - 0.9505) < 1e-12
    assert abs(t["Medium"]["min_prob"] - 0.8515) < 1e-12
    assert t["Low"]["max_prob"] == t["Medium"]["min_prob"]


def test_no_positives(spark):
    df = spark.createDataFrame([(0.2, 0), (0.7, 0), (0.7, 0)], "churn_probability double, is_churn int")
    assert ev.roc_auc(df).first()[0] is None
    assert ev.average_precision(df).first()[0] is None
    pr = ev.pr_curve(df, 5).toPandas()
    assert set(pr[pr["idx"] < 2]["recall"]) == {1.0}          # recall is 1 with no positives
    r = ev.confusion(df, 0.5).first()
    assert (r["tp"], r["precision"], r["recall"], r["f1_score"]) == (0, 0.0, 0.0, 0.0)


def test_summary_equals_the_single_measures(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101 / 100.0).alias("churn_probability"),
                                 F.when(F.col("id") % 50 == 7, F.lit(None)).otherwise((F.col("id") % 3 == 0).cast("int")).alias("is_churn"))
    for frame in (df, df.where("is_churn = 1"), df.limit(0)):
        s, c = ev.summary(frame, 0.3).first(), ev.confusion(frame, 0.3).first()
        for name in c.asDict():
            assert s[name] == c[name] or abs(s[name] - c[name]) < 1e-12
        for name, single in (("roc_auc", ev.roc_auc(frame).first()[0]), ("pr_auc", ev.average_precision(frame).first()[0])):
            assert s[name] == single or abs(s[name] - single) < 1e-12
