"""Per-row attribution for MLlib boosted trees (X1 step 2): exact
path-dependent Shapley values (Lundberg et al., 2020).

For a leaf with value v whose root path tests the unique features P (k of
them), missing features follow both branches weighted by training cover, so
with z_j = product of cover fractions of j's splits on the path and
o_j = 1 if the row takes j's path direction at all of them,

    phi_i(leaf) = v * (o_i - z_i) * sum_s c_s * s! (k-1-s)! / k!,

where c_s is the t^s coefficient of prod_{j in P, j != i} (z_j + o_j t).
Summed over leaves and trees (times the tree weights), the values add up to
the row's margin minus the cover-weighted expected margin.

Cost: a row's values at a leaf only depend on its pattern of o, so they are
worked out once per leaf and pattern: the product over all features is built
once (k steps) and each feature is divided out of it (k steps each), which makes
leaves x depth^2 per pattern.  Neighbouring leaves that share most of their tests
form a group with one table: the values added up over its leaves, per outcome of
its tests.  The tables are built once per model; a row block then looks the
outcomes of its rows up, one value per feature of the group.  Tests that several
groups share are evaluated once per block, and leaves with the same path (tests
and fractions) are one leaf.

Execution: the fitted tree stage is saved to the shared checkpoint folder and
its node table (bounded by the model size: trees x 2^depth rows) is read back
and turned into these groups, broadcast once.  Rows are scored
by a Pandas UDF over the feature vectors (Arrow batches; numpy vectorised over the rows of each
batch), so the work is partitioned with the data and nothing per-row passes
through the driver.  Values are reported on the log-odds scale (Spark's GBT
margin is half the log-odds).
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.session import shared_folder


# A table has at most 2^8 rows (16 KB with 8 features), all tables of a model 64 MB.
GROUP_TESTS, TABLE_VALUES = 8, 8_000_000


@dataclass
class Leaf:
    value: float              # leaf prediction x tree weight x scale
    features: list[int]       # unique features on the root path
    z: np.ndarray             # cover fraction per feature
    conds: list[list[tuple]]  # per feature: (is_categorical, threshold or categories, go_left)


def _shapley_weights(k: int) -> np.ndarray:
    return np.array([math.factorial(s) * math.factorial(k - 1 - s) / math.factorial(k) for s in range(k)])


def leaves_from_nodes(nodes: pd.DataFrame, tree_weights: dict[int, float], scale: float = 2.0) -> tuple[list[Leaf], float]:
    """Per-leaf path descriptions and the expected value from a node table with
    columns treeID, id, prediction, cover, leftChild, rightChild, featureIndex,
    split_values, numCategories."""
    leaves: list[Leaf] = []
    base = 0.0
    for tid, t in nodes.groupby("treeID"):
        by_id = {int(r.id): r for r in t.itertuples(index=False)}
        w = tree_weights[int(tid)] * scale
        stack = [(0, [])]
        while stack:
            nid, path = stack.pop()
            node = by_id[nid]
            if node.leftChild < 0:
                feats: dict[int, list] = {}
                z: dict[int, float] = {}
                for f, cond, frac in path:
                    feats.setdefault(f, []).append(cond)
                    z[f] = z.get(f, 1.0) * frac
                order = list(feats)
                leaves.append(Leaf(float(node.prediction) * w, order, np.array([z[f] for f in order]),
                                   [feats[f] for f in order]))
                reach = float(np.prod([frac for _, _, frac in path])) if path else 1.0
                base += float(node.prediction) * w * reach
                continue
            f = int(node.featureIndex)
            is_cat = int(node.numCategories) >= 0
            vals = np.array(node.split_values, dtype=float)
            split = vals if is_cat else float(vals[0])
            for child, go_left in ((int(node.leftChild), True), (int(node.rightChild), False)):
                frac = float(by_id[child].cover) / float(node.cover) if node.cover else 0.0
                stack.append((child, path + [(f, (is_cat, split, go_left), frac)]))
    return leaves, base


def merged_paths(leaves: list[Leaf]) -> list[Leaf]:
    """Leaves with equal tests and cover fractions as one, their values summed."""
    out: dict[tuple, Leaf] = {}
    for leaf in leaves:
        tests = tuple((f, tuple(sorted((cat, tuple(np.atleast_1d(split)), left) for cat, split, left in conds)))
                      for f, conds in zip(leaf.features, leaf.conds))
        key = (tests, tuple(leaf.z))
        if key in out:
            out[key] = replace(out[key], value=out[key].value + leaf.value)
        else:
            out[key] = leaf
    return list(out.values())


def pattern_values(z: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """(o_i - z_i) * sum_s c_s s! (k-1-s)! / k! per pattern (row of ``taken``) and feature.

    The product of all factors (z_j + o_j t) is built once; a factor is divided out from the
    top coefficient where o = 1 (|z| <= 1 keeps that stable) and by z alone where o = 0.
    z = 0 = o has weight zero and is never divided by."""
    n, k = taken.shape
    o = taken.astype(float)
    product = np.zeros((n, k + 1))
    product[:, 0] = 1.0
    for j in range(k):
        shifted = product[:, :j + 1] * o[:, j:j + 1]
        product *= z[j]
        product[:, 1:j + 2] += shifted
    weights, out = _shapley_weights(k), np.empty((n, k))
    for i in range(k):
        rest = np.zeros(n)
        carry = np.zeros(n)
        for s in range(k - 1, -1, -1):        # c_s of the product without feature i
            carry = product[:, s + 1] - z[i] * carry
            rest += weights[s] * carry
        if z[i]:
            rest = np.where(taken[:, i], rest, product[:, :k] @ weights / z[i])
        out[:, i] = (o[:, i] - z[i]) * rest
    return out


def _test(f: int, cond: tuple) -> tuple:
    is_cat, split, _ = cond
    return f, is_cat, tuple(split) if is_cat else split


def leaf_groups(leaves: list[Leaf]) -> list[tuple[list[Leaf], list[tuple]]]:
    """Runs of neighbouring leaves that have at most ``GROUP_TESTS`` different tests between
    them, and these tests; a leaf with more tests is alone.  A tree's leaves come in the order
    of its subtrees, so neighbours share most of their path."""
    groups: list[tuple[list[Leaf], list[tuple]]] = []
    for leaf in leaves:
        own = list(dict.fromkeys(_test(f, c) for f, conds in zip(leaf.features, leaf.conds) for c in conds))
        if not own:
            continue
        both = list(dict.fromkeys(groups[-1][1] + own)) if groups else own
        if groups and len(both) <= GROUP_TESTS:
            groups[-1] = (groups[-1][0] + [leaf], both)
        else:
            groups.append(([leaf], own))
    return groups


def group_values(leaves: list[Leaf], tests: list[tuple], codes: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The features on the paths of ``leaves`` and their values (codes x features), added up over
    the leaves, for rows that go left at test b where bit b of the code is set."""
    bit = {test: b for b, test in enumerate(tests)}
    features = sorted({f for leaf in leaves for f in leaf.features})
    at = {f: i for i, f in enumerate(features)}
    out = np.zeros((len(codes), len(features)))
    for leaf in leaves:
        taken = np.ones((len(codes), len(leaf.features)), bool)
        for a, (f, conds) in enumerate(zip(leaf.features, leaf.conds)):
            for cond in conds:
                taken[:, a] &= (codes >> bit[_test(f, cond)] & 1).astype(bool) == cond[2]
        patterns, which = np.unique(taken @ (1 << np.arange(len(leaf.features))), return_inverse=True)
        table = leaf.value * pattern_values(leaf.z, (patterns[:, None] >> np.arange(len(leaf.features)) & 1).astype(bool))
        out[:, [at[f] for f in leaf.features]] += table[which]
    return features, out


@dataclass
class Group:
    tests: list[tuple]
    features: list[int]
    values: np.ndarray | None    # 2^tests x features; None without a table: worked out per block
    leaves: list[Leaf]


def grouped(leaves: list[Leaf]) -> list[Group]:
    """The ensemble as groups of leaves, each with its table of values per outcome of its tests.
    Groups with too many tests, or beyond the room for tables, keep their leaves."""
    out, room = [], TABLE_VALUES
    for members, tests in leaf_groups(leaves):
        room -= len({f for f, _, _ in tests}) << min(len(tests), GROUP_TESTS)
        if len(tests) <= GROUP_TESTS and room >= 0:
            out.append(Group(tests, *group_values(members, tests, np.arange(1 << len(tests))), []))
        else:
            out.append(Group(tests, [], None, members))
    return out


def shap_groups(X: np.ndarray, groups: list[Group], n_features: int) -> np.ndarray:
    """Shapley values (rows x features) of the whole ensemble for a batch."""
    n = X.shape[0]
    phi = np.zeros((n_features, n))
    columns = np.ascontiguousarray(X.T)
    went_left: dict[tuple, np.ndarray] = {}

    def left(test: tuple) -> np.ndarray:
        if test not in went_left:
            f, is_cat, split = test
            went_left[test] = np.isin(columns[f], split) if is_cat else columns[f] <= split
        return went_left[test]

    for g in groups if n else ():
        kind = np.uint16 if len(g.tests) <= 16 else np.int64
        code = np.zeros(n, kind)
        for b, test in enumerate(g.tests):
            code |= left(test).astype(kind) << kind(b)
        if g.values is None:
            codes = np.arange(1 << len(g.tests)) if 1 << len(g.tests) <= n else None
            if codes is None:                  # many tests: only the outcomes that occur
                codes, code = np.unique(code, return_inverse=True)
            features, values = group_values(g.leaves, g.tests, codes.astype(np.int64))
        else:
            features, values = g.features, g.values
        for i, f in enumerate(features):
            phi[f] += values[:, i][code]
    return phi.T


def shap_matrix(X: np.ndarray, leaves: list[Leaf], n_features: int) -> np.ndarray:
    """Shapley values (rows x features) of the leaves for a batch."""
    return shap_groups(X, grouped(leaves), n_features)


def read_tree_model(spark: SparkSession, gbt: GBTClassificationModel, folder: str | None = None):
    """Save the tree stage to the shared folder and read its node table back
    (one row per node; the model size, not the data size)."""
    folder = folder or shared_folder(spark)
    path = f"{folder.rstrip('/')}/treeshap-{uuid.uuid4().hex}"
    gbt.write().overwrite().save(path)
    nodes = (spark.read.parquet(f"{path}/data")
             .select("treeID", "nodeData.id", "nodeData.prediction",
                     F.element_at("nodeData.impurityStats", 1).alias("cover"),
                     "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
                     F.col("nodeData.split.leftCategoriesOrThreshold").alias("split_values"),
                     "nodeData.split.numCategories")
             .toPandas())
    meta = spark.read.parquet(f"{path}/treesMetadata")      # (treeID, metadata json, weight) tuples
    tid, wcol = ("treeID", "weights") if "treeID" in meta.columns else ("_1", "_3")
    weights = {int(r[0]): float(r[1]) for r in meta.select(tid, wcol).collect()}
    return nodes, weights


def with_tree_contributions(model: PipelineModel, df: DataFrame, features_col: str = "features") -> DataFrame:
    """``df`` with X1 (trees): ``contributions`` array<struct<feature, pos, contribution>> in the
    assembler's input order, ``base_value`` and the model's ``margin``, all log-odds; base
    value and contributions add up to the margin.  Only the feature vectors go through
    Python; the other columns stay where they are, and nothing is shuffled."""
    gbt = next(s for s in model.stages if isinstance(s, GBTClassificationModel))
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    names = [c[:-5] if c.endswith("__idx") else c for c in assembler.getInputCols()]
    spark = df.sparkSession
    nodes, weights = read_tree_model(spark, gbt)
    leaves, base = leaves_from_nodes(nodes, weights, scale=2.0)
    shared = spark.sparkContext.broadcast(grouped(merged_paths(leaves)))
    m = len(names)

    @F.pandas_udf("array<double>")
    def values(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(shap_groups(np.stack(vectors.to_numpy()).astype(float), shared.value, m)))

    out = model.transform(df).withColumn("_phi", values(vector_to_array(F.col(features_col))))
    contrib = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(i).alias("pos"),
                                 F.col("_phi")[i].alias("contribution")) for i, n in enumerate(names)])
    return out.select(*df.columns, contrib.alias("contributions"), F.lit(base).alias("base_value"),
                      (F.lit(2.0) * vector_to_array(F.col(gbt.getRawPredictionCol()))[1]).alias("margin"))


def tree_contributions(model: PipelineModel, df: DataFrame, key: str = "msno", features_col: str = "features") -> DataFrame:
    """The key, ``contributions``, ``base_value`` and ``margin`` of every row."""
    return with_tree_contributions(model, df, features_col).select(F.col(key).cast("string").alias(key), "contributions",
                                                                   "base_value", "margin")
