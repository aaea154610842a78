"""Tree attribution: brute-force Shapley on a small model, and additivity."""

import itertools
import math

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lapse.operators import treeshap as ts


def _model(spark):
    rng = np.random.default_rng(11)
    n = 300
    a, b, c = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    d = rng.choice(["x", "y", "z"], size=n)
    y = ((a + (d == "y") * 1.5 + 0.5 * b + rng.normal(scale=0.5, size=n)) > 0.3).astype(int)
    rows = [(str(i), float(a[i]), float(b[i]), float(c[i]), str(d[i]), int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "msno string, a double, b double, c double, d string, is_churn int")
    pipe = Pipeline(stages=[StringIndexer(inputCol="d", outputCol="d__idx"),
                            VectorAssembler(inputCols=["a", "b", "c", "d__idx"], outputCol="features"),
                            GBTClassifier(labelCol="is_churn", maxIter=4, maxDepth=3, seed=1)])
    return pipe.fit(df), df


def _expect(tree, node_id, x, S):
    node = tree[node_id]
    if node["leftChild"] < 0:
        return node["prediction"]
    f = int(node["featureIndex"])
    is_cat = int(node["numCategories"]) >= 0
    vals = node["split_values"]
    left_id, right_id = int(node["leftChild"]), int(node["rightChild"])
    if f in S:
        go_left = (x[f] in set(vals)) if is_cat else (x[f] <= vals[0])
        return _expect(tree, left_id if go_left else right_id, x, S)
    lc, rc = tree[left_id]["cover"], tree[right_id]["cover"]
    return (lc * _expect(tree, left_id, x, S) + rc * _expect(tree, right_id, x, S)) / node["cover"]


def test_matches_brute_force_and_adds_up(spark):
    model, df = _model(spark)
    gbt = model.stages[-1]
    nodes, weights = ts.read_tree_model(spark, gbt)
    trees = {tid: {int(r["id"]): r for r in t.to_dict("records")} for tid, t in nodes.groupby("treeID")}
    X = np.stack(model.transform(df).select(vector_to_array("features").alias("x")).toPandas()["x"].to_numpy())
    leaves, base = ts.leaves_from_nodes(nodes, weights, scale=2.0)
    phi = ts.shap_matrix(X[:5], leaves, 4)
    m = 4
    for r in range(5):
        x = X[r]

        def f(S):
            return sum(2.0 * weights[t] * _expect(trees[t], 0, x, S) for t in trees)
        for i in range(m):
            others = [j for j in range(m) if j != i]
            val = 0.0
            for size in range(m):
                for S in itertools.combinations(others, size):
                    w = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                    val += w * (f(set(S) | {i}) - f(set(S)))
            assert abs(val - phi[r, i]) < 1e-9
        assert abs(f(set()) - base) < 1e-9

    out = ts.tree_contributions(model, df)
    total = out.select("msno", (F.col("base_value") + F.aggregate("contributions", F.lit(0.0),
                                                                  lambda acc, c: acc + c["contribution"])).alias("s"))
    margin = model.transform(df).select("msno", (2.0 * vector_to_array("rawPrediction")[1]).alias("m"))
    diff = total.join(margin, "msno").select(F.max(F.abs(F.col("s") - F.col("m")))).first()[0]
    assert diff < 1e-9


def _slow_matrix(X, leaves, n_features):
    """The definition: per leaf and feature the product over the other features, row by row."""
    phi = np.zeros((len(X), n_features))
    for leaf in leaves:
        k = len(leaf.features)
        for r, x in enumerate(X):
            o = [all((x[f] in set(np.atleast_1d(s)) if cat else x[f] <= s) == left for cat, s, left in conds)
                 for f, conds in zip(leaf.features, leaf.conds)]
            for i in range(k):
                poly = [1.0]
                for j in range(k):
                    if j != i:
                        poly = [a + b for a, b in zip([c * leaf.z[j] for c in poly] + [0.0], [0.0] + [c * o[j] for c in poly])]
                weight = sum(c * math.factorial(s) * math.factorial(k - 1 - s) / math.factorial(k) for s, c in enumerate(poly))
                phi[r, leaf.features[i]] += leaf.value * (o[i] - leaf.z[i]) * weight
    return phi


def test_divided_products_equal_the_definition():
    """Random paths of up to 11 features, repeated features, zero and full cover fractions,
    categories, blocks shorter and longer than the number of patterns."""
    rng = np.random.default_rng(5)
    leaves = []
    for _ in range(60):
        k = int(rng.integers(1, 12))
        features = rng.permutation(12)[:k].tolist()
        z = rng.choice([0.0, 1.0, *rng.random(6)], size=k)
        conds = [[(False, float(np.round(rng.normal(), 1)), bool(rng.integers(2))) for _ in range(rng.integers(1, 3))]
                 if f % 4 else [(True, np.array([0.0, 2.0]), bool(rng.integers(2)))] for f in features]
        leaves.append(ts.Leaf(float(rng.normal()), features, z, conds))
    leaves += [leaves[0], leaves[3]]
    X = np.round(rng.normal(size=(90, 12)), 1)
    X[:, ::4] = rng.integers(0, 4, size=X[:, ::4].shape)
    want = _slow_matrix(X, leaves, 12)
    for rows in (X, X[:3], X[:0]):
        assert np.allclose(ts.shap_matrix(rows, leaves, 12), want[:len(rows)], atol=1e-9)
        assert np.allclose(ts.shap_matrix(rows, ts.merged_paths(leaves), 12), want[:len(rows)], atol=1e-9)
    assert len(ts.merged_paths(leaves)) == 60


def _whole_trees(rng, trees, depth):
    """Leaves of complete trees in the order of their subtrees."""
    leaves = []
    for _ in range(trees):
        tests = {}
        for i in range(1 << depth):
            feats, z = {}, {}
            for d in range(depth):
                node = (d, i >> (depth - d))
                if node not in tests:
                    f = int(rng.integers(12))
                    tests[node] = (f, f % 4 == 0, np.array([0.0, 2.0]) if f % 4 == 0 else float(np.round(rng.normal(), 1)), rng.random())
                f, cat, split, share = tests[node]
                left = not i >> (depth - d - 1) & 1
                feats.setdefault(f, []).append((cat, split, left))
                z[f] = z.get(f, 1.0) * (share if left else 1 - share)
            leaves.append(ts.Leaf(float(rng.normal()), list(feats), np.array([z[f] for f in feats]), list(feats.values())))
    return leaves


def test_tables_are_built_once_for_neighbouring_leaves(monkeypatch):
    rng = np.random.default_rng(8)
    leaves = _whole_trees(rng, 3, 5)
    X = np.round(rng.normal(size=(40, 12)), 1)
    X[:, ::4] = rng.integers(0, 4, size=X[:, ::4].shape)
    want = _slow_matrix(X, leaves, 12)
    groups = ts.grouped(leaves)
    assert len(groups) <= len(leaves) // 4 and all(g.values is not None for g in groups)
    for name, value in (("TABLE_VALUES", 0), ("TABLE_VALUES", 5000), ("GROUP_TESTS", 1), ("GROUP_TESTS", 12)):
        with monkeypatch.context() as m:        # without tables, with some, leaf by leaf, large groups
            m.setattr(ts, name, value)
            assert np.allclose(ts.shap_matrix(X, leaves, 12), want, atol=1e-9)
    monkeypatch.setattr(ts, "pattern_values", None)            # a block of rows only looks values up
    for rows in (X, X[:1], X[:0]):
        assert np.allclose(ts.shap_groups(rows, groups, 12), want[:len(rows)], atol=1e-9)
