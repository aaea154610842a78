"""Distributed isotonic calibration against one pooling and the min-max formula."""

import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from lapse.operators import isotonic as iso
from lapse.operators import ml
from lapse.plans import catalog


def frame(spark, rows):
    return spark.createDataFrame(rows, "churn_probability double, is_churn int")


def collapsed(rows):
    out = {}
    for s, y in rows:
        if s is not None and y is not None:
            out.setdefault(s, [0, 0])
            out[s][0] += 1
            out[s][1] += y
    return sorted((s, *c) for s, c in out.items())


@pytest.mark.parametrize("kind", ["noisy", "rising", "falling", "few"])
def test_blocks_for_any_number_of_parts(spark, kind):
    rng = random.Random(kind)
    n = {"few": 3}.get(kind, 900)
    p = {"noisy": lambda s: 0.3 + 0.3 * s, "rising": lambda s: s, "falling": lambda s: 1 - s, "few": lambda s: s}[kind]
    scores = [round(rng.random(), 3) for _ in range(n)]
    rows = [(s, int(rng.random() < p(s))) for s in scores] + [(None, 1), (0.5, None)]
    want = [tuple(b) for b in iso.pooled([], ((s, s, k, y) for s, k, y in collapsed(rows)))]
    for parts in (1, 7, 70):
        got = iso.isotonic_blocks(frame(spark, rows), parts=parts).collect()
        assert [tuple(r)[:4] for r in got] == want
        assert all(a.rate < b.rate and a.high < b.low for a, b in zip(got, got[1:]))
        assert sum(r.n for r in got) == n


def test_scores_follow_the_min_max_formula_and_mllib(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.5)) for _ in range(400)]
    df, table = frame(spark, rows), collapsed(rows)
    got = {r.score: r.calibrated for r in iso.calibrated_scores(df).collect()}
    for i in range(len(table)):
        best = max(min(sum(y for _, _, y in table[a:b]) / sum(n for _, n, _ in table[a:b]) for b in range(i + 1, len(table) + 1))
                   for a in range(i + 1))
        assert abs(got[table[i][0]] - best) < 1e-12
    # On raw rows MLlib fits the same function, between and beyond the scores as well.
    plain = IsotonicRegression(featuresCol="_raw", labelCol="is_churn", predictionCol="_cal").fit(df.withColumnRenamed("churn_probability", "_raw"))
    model = iso.isotonic_model(iso.isotonic_blocks(df))
    grid = spark.range(-50, 1100).select((F.col("id") / 1000.0).alias("_raw"))
    a, b = ({r._raw: r._cal for r in m.transform(grid).collect()} for m in (plain, model))
    assert max(abs(a[x] - b[x]) for x in a) < 1e-9


class Given:
    """Stands for a fold's trees and its calibration: scores and calibrated values are columns of the rows."""

    def __init__(self, calibrated):
        self.calibrated = calibrated

    def setFeaturesCol(self, name):
        return self

    def setPredictionCol(self, name):
        return self

    def transform(self, df):
        p = F.col("score")
        return df.withColumns({"probability": array_to_vector(F.array(1 - p, p)), "_cal": F.col(self.calibrated)})


def test_calibration_checks_compare_every_score(spark, monkeypatch):
    rng = random.Random(5)
    scores = sorted({round(rng.random(), 3) for _ in range(300)} | {0.50101, 0.50102, 0.7001, 0.7002, 0.0, 1.0})

    def fall(at, by=0.2):
        return {s: s - by if s == at else s for s in scores}

    cases = {"rising": {s: s for s in scores}, "flat": dict.fromkeys(scores, 0.5), "same_digits": fall(0.50102, 2e-5),
             "same_window": fall(0.7002, 2e-4), "far": fall(0.7001), "last": fall(1.0), "high": {s: s * 1.01 for s in scores},
             "low": {s: s - 0.01 for s in scores}}
    rows = [(s, *(c[s] for c in cases.values())) for s in scores for _ in range(2)]
    rng.shuffle(rows)
    data = spark.createDataFrame(rows, ["score", *cases])
    ens = ml.CalibratedEnsemble([(Given(c), Given(c)) for c in cases])
    monkeypatch.setattr(catalog, "_fit_calibrated_trees", lambda spark, sf_dir: (ens, data))
    got = {list(cases)[r.fold]: (r.never_falls, r.in_range) for r in catalog.q_calibration_checks(spark, "").collect()}
    assert got == {"rising": (True, True), "flat": (True, True), "same_digits": (False, True), "same_window": (False, True),
                   "far": (False, True), "last": (False, True), "high": (True, False), "low": (True, False)}


@pytest.mark.parametrize("buckets", [2, 4096])
def test_order_checks_follow_the_pairs(spark, buckets):
    rng, found = random.Random(7), set()
    for _ in range(6):
        pairs = {x: x + (rng.random() - 0.5) * 0.01 for x in (round(rng.random(), 2) / rng.choice((1, 1000)) for _ in range(25))}
        rows = sorted(pairs.items())
        if rng.random() < 0.5:                          # its values in order: never falling
            rows = list(zip(sorted(pairs), sorted(pairs.values())))
        want = (all(a[1] <= b[1] for i, a in enumerate(rows) for b in rows[i:]), all(0 <= y <= 1 for _, y in rows))
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "_raw double, _cal double")
        got = iso.order_checks(df, buckets=buckets).collect()
        assert [tuple(r) for r in got] == [want]
        found.add(want[0])
    assert found == {True, False}
    drift = spark.range(4000).select((F.col("id") / 4000).alias("_raw"), (0.5 - F.col("id") * 1e-15).alias("_cal"))
    missing = spark.createDataFrame([(0.1, 0.2), (0.3, None)], "_raw double, _cal double")
    assert [tuple(iso.order_checks(d, buckets=buckets).first()) for d in (drift, missing)] == [(False, True), (True, False)]
