"""Model operators: exact split, weights, pipelines, calibration (rows + sanity)."""

import math

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from lapse.operators import attribute as at
from lapse.operators import ml
from lapse.operators.evaluate import average_precision
from lapse.session import materialize
from lapse.sources import writers


def _table(spark):
    from lapse.plans import catalog
    return catalog.feature_table(spark, "/root/testdata/sf0.001")


def test_stratified_split_is_exact(spark):
    df = ml.stratified_split(_table(spark), 0.2, 3, 42)
    per = {(r["is_churn"], r["split"]): r["n"] for r in df.groupBy("is_churn", "split").agg(F.count("*").alias("n")).collect()}
    for lab in (0, 1):
        total = per.get((lab, "test"), 0) + per.get((lab, "train"), 0)
        assert per.get((lab, "test"), 0) == math.ceil(total * 0.2)
    folds = df.filter("split = 'train'").groupBy("is_churn", "fold").count().collect()
    by_label = {}
    for r in folds:
        by_label.setdefault(r["is_churn"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by_label.values())
    again = ml.stratified_split(_table(spark).repartition(5), 0.2, 3, 42)
    assert df.select("msno", "split", "fold").exceptAll(again.select("msno", "split", "fold")).count() == 0


def test_class_weight_formula(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "is_churn int")
    w = {r["is_churn"]: r["weight"] for r in ml.with_class_weights(df).collect()}
    assert w == {1: 3.0, 0: 1.0}
    wb = {r["is_churn"]: r["weight"] for r in ml.with_class_weights(df, mode="balanced").collect()}
    assert wb == {1: 2.0, 0: 4 / 6}
    none = spark.createDataFrame([(0,), (0,)], "is_churn int")
    assert {r["weight"] for r in ml.with_class_weights(none).collect()} == {1.0}


def test_linear_model_scores_and_contributions_add_up(spark, tmpdir_path):
    data = ml.stratified_split(_table(spark), 0.2, 3, 42)
    train = ml.with_class_weights(data.filter("split = 'train'"), mode="balanced")
    model = ml.linear_pipeline(reg_param=ml.l2_for_c(train)).fit(train)
    scores = ml.score(model, data.filter("split = 'test'"))
    probs = [r["churn_probability"] for r in scores.collect()]
    assert probs and all(0.0 <= p <= 1.0 for p in probs)
    contrib = at.linear_contributions(model, data, train)
    margin = model.transform(data).select("msno", F.col("rawPrediction"))
    from pyspark.ml.functions import vector_to_array
    margin = margin.select("msno", vector_to_array("rawPrediction")[1].alias("m"))
    total = contrib.select("msno", (F.col("base_value") + F.aggregate(
        F.col("contributions"), F.lit(0.0), lambda a, c: a + c["contribution"])).alias("s"))
    diff = total.join(margin, "msno").select(F.max(F.abs(F.col("s") - F.col("m")))).first()[0]
    assert diff < 1e-6
    writers.save_model(model, f"{tmpdir_path}/lr")
    again = writers.load_model(f"{tmpdir_path}/lr")
    assert ml.score(again, data.filter("split = 'test'")).count() == len(probs)


def test_calibrated_trees_monotone_and_bounded(spark):
    data = ml.stratified_split(_table(spark), 0.2, 3, 42)
    train = ml.with_class_weights(data.filter("split = 'train'"))
    ens = ml.fit_calibrated(train, lambda: ml.tree_pipeline(ml.TreeParams(max_iter=5, max_depth=3)), folds=3)
    out = ens.transform(data.filter("split = 'test'")).select("churn_probability").collect()
    assert out and all(0.0 <= r[0] <= 1.0 for r in out)
    for _, iso in ens.members:
        preds = list(iso.predictions)
        assert preds == sorted(preds)


def _made_rows(spark, n=240):
    rows = [(str(i), (i * 7 % 11 + i % 3) % 2, float(i * 13 % 17), None if i % 5 == 0 else "abc"[i % 3], i % 4, i % 3, 1.0 + i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "msno string, is_churn int, plan_list_price double, gender string, city int, fold int, weight double").coalesce(2)


def _watch_fits(monkeypatch):
    """The inputs of every tree fit from here on."""
    seen, fit = [], GBTClassifier.fit

    def watched(self, dataset, params=None):
        seen.append(dataset)
        return fit(self, dataset, params)

    monkeypatch.setattr(GBTClassifier, "fit", watched)
    return seen


def _trees(model):
    return model.toDebugString.split("\n", 1)[1]


FEATURES = ("city", "gender", "plan_list_price")


def test_fold_fits_read_prepared_rows(spark, monkeypatch):
    train = materialize(_made_rows(spark))

    def pipeline():
        return ml.tree_pipeline(ml.TreeParams(max_iter=3, max_depth=3), FEATURES)

    plain = [pipeline().fit(train.filter(F.col("fold") != k)).stages[-1] for k in range(3)]
    seen = _watch_fits(monkeypatch)
    ens = ml.fit_calibrated(train, pipeline, folds=3)
    assert [_trees(base.stages[-1]) for base, _ in ens.members] == [_trees(m) for m in plain]
    assert len(seen) == 3
    for df in seen:
        assert df.columns == ["features", "is_churn", "weight"]
        assert "UDF" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert pipeline().getStages()[-1].getCheckpointInterval() <= 10    # lineage between checkpoints


def test_search_prepares_its_rows_once(spark, monkeypatch):
    train = materialize(_made_rows(spark).withColumns({c: F.lit(1) for c in ml.MODEL_FEATURES if c not in FEATURES}))
    base = ml.TreeParams(max_iter=1)

    def judged(p, k):                                  # every fit from the rows themselves
        marked = train.withColumn("_validation", F.col("fold") == k)
        pipe = ml.tree_pipeline(p)
        pipe.getStages()[-1].setValidationIndicatorCol("_validation")
        return average_precision(ml.score(pipe.fit(marked), marked.filter("_validation"))).first()[0]

    tried = ml.random_search(ml.with_bins(base, train), 2, 42)
    expect = [(p, sum(judged(p, k) for k in range(3)) / 3) for p in tried]
    seen = _watch_fits(monkeypatch)
    _, found = ml.search_tree_params(train, trials=2, folds=3, base=base)
    assert found == expect
    assert len(seen) == 6 and all("UDF" not in df._jdf.queryExecution().optimizedPlan().toString() for df in seen)


def test_fit_table_works_the_features_out_once(spark, monkeypatch):
    from lapse.plans import catalog
    rows, read = 60, spark.sparkContext.accumulator(0)

    def name(i: int) -> str:
        read.add(1)
        return str(i)

    made = spark.range(rows).select(F.udf(name, "string")("id").alias("msno"), (F.col("id") % 2).cast("int").alias("is_churn"))
    monkeypatch.setattr(catalog, "feature_table", lambda spark, sf_dir: made)
    found = catalog.fit_table(spark, "")
    assert found.count() == rows and read.value == rows
    assert found.exceptAll(ml.stratified_split(made, 0.2, 3, 42)).count() == 0


def test_search_returns_best_parameters(spark):
    data = ml.stratified_split(_table(spark), 0.2, 3, 42)
    train = materialize(ml.with_class_weights(data.filter("split = 'train'")))
    best, tried = ml.search_tree_params(train, trials=2, folds=3, base=ml.TreeParams(max_iter=3, max_depth=2))
    assert len(tried) == 2 and all(0 < ap <= 1 for _, ap in tried)
    assert best == max(tried, key=lambda t: t[1])[0]
    assert all(3 <= p.max_depth <= 9 and 0.01 <= p.step_size <= 0.3 and p.max_iter == 3 for p, _ in tried)


def test_linear_contributions_are_looked_up_per_category(spark):
    rows = [(str(i), i % 2, float(i % 7), None if i % 5 == 0 else "abc"[i % 3], i % 4) for i in range(60)]
    train = spark.createDataFrame(rows, "msno string, is_churn int, plan_list_price double, gender string, city int")
    features = ("city", "gender", "plan_list_price")
    model = ml.linear_pipeline(features=features).fit(train.withColumn("weight", F.lit(1.0)))
    odd = spark.createDataFrame([("x", 0, 2.5, "unseen", 1), ("y", 1, 9.0, None, 99)], train.schema)
    both = train.unionByName(odd)
    contrib = at.linear_contributions(model, both, train, features)
    plan = contrib._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan                       # no walk over the design columns of each row
    design = {r["msno"]: r["features"].toArray() for r in model.transform(both).select("msno", "features").collect()}
    w, mean = model.stages[-1].coefficients.toArray(), sum(design[str(i)] for i in range(60)) / 60
    n_city = model.stages[2].categorySizes[0] - 1
    for r in contrib.collect():
        part = w * (design[r["msno"]] - mean)
        expect = {"plan_list_price": part[0], "city": part[1:1 + n_city].sum(), "gender": part[1 + n_city:].sum()}
        assert all(abs(c["contribution"] - expect[c["feature"]]) < 1e-9 for c in r["contributions"])


def test_long_contributions_are_worked_out_once(spark):
    @F.pandas_udf("array<double>")
    def values(x: pd.Series) -> pd.Series:
        return x.map(lambda v: [v, -v])

    df = spark.range(3).select(F.col("id").cast("string").alias("msno"), values(F.col("id").cast("double")).alias("_phi"))
    parts = [F.struct(F.lit(n).alias("feature"), F.lit(i).alias("pos"), F.col("_phi")[i].alias("contribution")) for i, n in enumerate("ab")]
    long = at.contributions_long(df.select("msno", F.array(*parts).alias("contributions")))
    assert long._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, long.collect())) == sorted((str(i), n, s * i) for i in range(3) for n, s in (("a", 1.0), ("b", -1.0)))
    none = spark.createDataFrame([("x", None), ("y", [])], "msno string, contributions array<struct<feature:string,pos:int,contribution:double>>")
    assert at.contributions_long(none).columns == ["msno", "feature", "contribution"] and at.contributions_long(none).collect() == []
