"""Distributed model operators with Spark ML (M1-M9).

* M1/M2: exact stratified split and folds from a per-label rank in seeded
  md5 order -- ranks come from bucketed running totals (no per-label window
  holding half the table in one task).  ``sampleBy`` would be Bernoulli,
  not exact.
* M3: class weights from one aggregate, attached as a column.
* M4-M6: ``Pipeline`` of ``StringIndexer``/``OneHotEncoder``/``StandardScaler``
  with ``LogisticRegression`` or ``GBTClassifier`` (categoricals native to the
  trees through nominal metadata).
* M7: seeded random search scored by ``CrossValidator`` over the fold column.
* M8: isotonic calibration over folds: per fold a base model on the other
  folds and a distributed isotonic fit of its held-out scores; the final score is
  the mean of the calibrated outputs.
* M9: batch scoring = ``transform`` + ``vector_to_array(probability)[1]``.

Iterative fits checkpoint into ``spark.checkpoint.dir`` when the session
names one (see :func:`lapse.session.ensure_checkpoint_dir`).
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from lapse.config import CATEGORICAL_FEATURES, MODEL_FEATURES, NON_MODEL_COLUMNS
from lapse.operators.cumulative import running_totals
from lapse.operators.evaluate import average_precision
from lapse.operators.isotonic import isotonic_blocks, isotonic_model
from lapse.session import materialize

LABEL = "is_churn"
HASH_SPAN = float(16 ** 15)


def hash_rank_value(seed: int, key: str = "msno"):
    """md5(key:seed), first 15 hex digits, as a number: a seeded order that
    any engine reproduces and that does not depend on partitioning."""
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def stratified_split(df: DataFrame, test_fraction: float = 0.2, folds: int = 3, seed: int = 42,
                     label: str = LABEL, key: str = "msno") -> DataFrame:
    """M1 + M2: adds ``split`` ('train' / 'test') and ``fold`` (0..folds-1).

    Per label, rows are ranked in seeded hash order; the first
    ``ceil(test_fraction * n_label)`` are test, so the split is exact and
    stratified.  Training rows get folds round-robin on their rank among
    training rows, so folds are stratified and sizes differ by at most one.
    A row without a label stops the job: it can be neither stratified nor learnt from."""
    unknown = F.raise_error(F.concat(F.lit(f"no {label} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    df = df.withColumn(label, F.when(F.col(label).isNull(), unknown.cast(df.schema[label].dataType)).otherwise(F.col(label)))
    keyed = df.withColumns({"_h": hash_rank_value(seed, key), "_one": F.lit(1)})
    j = running_totals(keyed, ["_h", key], ["_one"], by=[label], lo=0.0, hi=HASH_SPAN, with_totals=True)
    n_test = F.ceil(F.col("total__one") * F.lit(float(test_fraction)))
    rank = F.col("cum__one")
    out = j.withColumns({
        "split": F.when(rank <= n_test, F.lit("test")).otherwise(F.lit("train")),
        "fold": F.when(rank <= n_test, F.lit(None).cast("int"))
                 .otherwise(F.pmod(rank - n_test - 1, F.lit(folds)).cast("int")),
    })
    return out.drop("_h", "_one", "cum__one", "total__one")


def with_class_weights(df: DataFrame, label: str = LABEL, mode: str = "scale_pos") -> DataFrame:
    """M3: ``weight`` column.  'scale_pos': positives weigh neg/pos (1.0 when no
    positives), negatives 1; 'balanced': n / (2 * n_class)."""
    y = F.col(label)
    # one subquery for both totals, wherever the expression uses them
    totals = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(y.cast("long")).alias("pos")).alias("t")).scalar()
    n, pos = totals["n"], totals["pos"]
    neg = n - pos
    if mode == "balanced":
        w = F.when(y == 1, F.try_divide(n.cast("double"), pos * 2)).otherwise(F.try_divide(n.cast("double"), neg * 2))
    else:
        w = F.when(y == 1, F.coalesce(F.try_divide(neg.cast("double"), pos), F.lit(1.0))).otherwise(F.lit(1.0))
    return df.withColumn("weight", w)


def model_input(df: DataFrame, features: tuple[str, ...] = MODEL_FEATURES,
                exclude: tuple[str, ...] = NON_MODEL_COLUMNS, keep: tuple[str, ...] = ()) -> DataFrame:
    """P2 + P3 + P4: the model's feature columns in model order (only those
    present), with id / label / excluded columns dropped unless kept, and
    numeric NULLs filled with 0 (categoricals stay text)."""
    present = [c for c in features if c in df.columns and c not in exclude]
    nums = [c for c in present if c not in CATEGORICAL_FEATURES]
    cols = [F.col(c) for c in keep if c in df.columns]
    cols += [F.coalesce(F.col(c), F.lit(0)).alias(c) if c in nums else F.col(c) for c in present]
    return df.select(*cols)


def through_model(df: DataFrame, apply: Callable[[DataFrame], DataFrame], features: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
    """``apply`` (a model's transform) on rows whose numeric NULLs are filled as in
    :func:`model_input`; the table's own columns come back as they were, NULLs included."""
    nums = [c for c in features if c in df.columns and c not in CATEGORICAL_FEATURES]
    aside = {c: f"__own_{c}" for c in nums}
    filled = df.withColumns({aside[c]: F.col(c) for c in nums}).withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in nums})
    out = apply(filled)
    added = [c for c in out.columns if c not in filled.columns]
    return out.select(*(F.col(aside[c]).alias(c) if c in aside else F.col(c) for c in df.columns), *added)


def sized(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """Few, full partitions for an iterative fit: every tree level is a job over all of them."""
    n = df.count()
    return df.coalesce(max(1, -(-n // rows)))


def numeric_features(features: tuple[str, ...] = MODEL_FEATURES) -> list[str]:
    return [c for c in features if c not in CATEGORICAL_FEATURES]


def _indexers(cats: list[str]) -> list[StringIndexer]:
    return [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep", stringOrderType="alphabetAsc")
            for c in cats]


def linear_pipeline(features: tuple[str, ...] = MODEL_FEATURES, max_iter: int = 1000,
                    reg_param: float = 0.0, tol: float = 1e-4) -> Pipeline:
    """M4 + M5: standardised numerics, one-hot categoricals (unseen -> all
    zeros), weighted logistic regression.  To mirror an L2 model with C = 1
    on n weighted rows use ``reg_param = 1 / n`` (see :func:`l2_for_c`); the
    design is already scaled, so no second internal standardisation."""
    cats = [c for c in features if c in CATEGORICAL_FEATURES]
    nums = numeric_features(features)
    stages = _indexers(cats)
    # The indexer puts unseen values in its last slot; dropLast removes that
    # slot, so an unseen value encodes as all zeros.
    stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in cats], outputCols=[f"{c}__ohe" for c in cats],
                                dropLast=True, handleInvalid="error"))
    stages.append(VectorAssembler(inputCols=nums, outputCol="num_vec", handleInvalid="keep"))
    stages.append(StandardScaler(inputCol="num_vec", outputCol="num_scaled", withMean=True, withStd=True))
    stages.append(VectorAssembler(inputCols=["num_scaled", *[f"{c}__ohe" for c in cats]], outputCol="features"))
    stages.append(LogisticRegression(featuresCol="features", labelCol=LABEL, weightCol="weight",
                                     maxIter=max_iter, regParam=reg_param, tol=tol, standardization=False))
    return Pipeline(stages=stages)


def l2_for_c(train: DataFrame, c: float = 1.0, weight: str = "weight") -> float:
    """regParam equal to an L2 penalty 1/(2C)||w||^2 on the summed loss:
    1 / (C * total weight).  One number brought to the driver."""
    total = train.agg(F.sum(weight)).first()[0] or 1.0
    return 1.0 / (c * float(total))


@dataclass
class TreeParams:
    # Tree settings of the model being matched.
    max_iter: int = 150
    max_depth: int = 6
    step_size: float = 0.1
    subsampling_rate: float = 1.0
    feature_subset: str = "all"
    max_bins: int = 128
    seed: int = 42
    extra: dict = field(default_factory=dict)


def tree_pipeline(p: TreeParams = TreeParams(), features: tuple[str, ...] = MODEL_FEATURES,
                  checkpoint_interval: int = 10) -> Pipeline:
    """M6: boosted trees; categoricals enter as indices with nominal metadata,
    so the trees split them natively (:func:`with_bins` widens ``maxBins`` to the
    widest one).  Every task of a round carries the lineage of all rounds since the last
    checkpoint, so the checkpoints are close together."""
    cats = [c for c in features if c in CATEGORICAL_FEATURES]
    stages = _indexers(cats)
    stages.append(VectorAssembler(inputCols=[*numeric_features(features), *[f"{c}__idx" for c in cats]],
                                  outputCol="features", handleInvalid="keep"))
    stages.append(GBTClassifier(featuresCol="features", labelCol=LABEL, weightCol="weight", maxIter=p.max_iter,
                                maxDepth=p.max_depth, stepSize=p.step_size, subsamplingRate=p.subsampling_rate,
                                featureSubsetStrategy=p.feature_subset, maxBins=p.max_bins, seed=p.seed,
                                checkpointInterval=checkpoint_interval, cacheNodeIds=False))
    return Pipeline(stages=stages)


def with_bins(p: TreeParams, train: DataFrame, features: tuple[str, ...] = MODEL_FEATURES) -> TreeParams:
    """``max_bins`` raised to the widest categorical of ``train`` and one bin for unseen values."""
    cats = [c for c in features if c in CATEGORICAL_FEATURES]
    widths = train.agg(*(F.count_distinct(c).alias(c) for c in cats)).first()
    return replace(p, max_bins=max(p.max_bins, max(widths, default=0) + 1))


def positive_probability(df: DataFrame, out: str = "churn_probability", prob_col: str = "probability") -> DataFrame:
    """M9 helper: P(class 1) out of the probability vector."""
    return df.withColumn(out, vector_to_array(F.col(prob_col))[1])


def score(model: PipelineModel, df: DataFrame, keep: tuple[str, ...] = ("msno",),
          out: str = "churn_probability") -> DataFrame:
    """M9: batch scoring of a whole table."""
    scored = positive_probability(model.transform(df), out)
    cols = [c for c in keep if c in df.columns]
    return scored.select(*cols, out, *([LABEL] if LABEL in df.columns and LABEL not in cols else []))


def prepared_rows(pipeline: Pipeline, rows: DataFrame, keep: tuple[str, ...] = ()) -> tuple[PipelineModel, DataFrame]:
    """The stages before a pipeline's last one, fitted, and the columns that the last one reads (and
    ``keep``), materialised: an iterative fit passes over its input several times and carries its
    lineage in every task."""
    *first, last = pipeline.getStages()
    before = Pipeline(stages=first).fit(rows)
    read = [last.getOrDefault(p) for p in ("featuresCol", "labelCol", "weightCol") if last.hasParam(p) and last.isDefined(p)]
    return before, materialize(before.transform(rows).select(*dict.fromkeys([*read, *keep])))


def fit_prepared(pipeline: Pipeline, rows: DataFrame) -> PipelineModel:
    """``pipeline.fit(rows)``, its last stage fitted on :func:`prepared_rows`."""
    before, ready = prepared_rows(pipeline, rows)
    return PipelineModel([*before.stages, pipeline.getStages()[-1].fit(ready)])


def random_search(base: TreeParams, trials: int = 5, seed: int = 42) -> list[TreeParams]:
    """M7 search space (log-uniform learning rate 0.01-0.3, depth 3-9, row and
    column subsampling 0.6-1), sampled with a fixed seed."""
    rng = random.Random(seed)
    return [replace(base, step_size=10 ** rng.uniform(-2, math.log10(0.3)), max_depth=rng.randint(3, 9),
                    subsampling_rate=rng.uniform(0.6, 1.0), feature_subset=f"{rng.uniform(0.6, 1.0):.3f}")
            for _ in range(trials)]


def search_tree_params(train: DataFrame, trials: int = 5, folds: int = 3, base: TreeParams = TreeParams(max_iter=100),
                       seed: int = 42, parallelism: int = 2) -> tuple[TreeParams, list[tuple[TreeParams, float]]]:
    """M7: seeded random search maximising the mean fold average precision (E2, unweighted).

    Each fit sees the other folds as training rows and its own as the validation rows that
    end boosting early (``validationIndicatorCol``), and is judged on its own fold.  Returns
    the best parameters and every trial with its score; no model is refitted.  The indices
    and vectors are those of all training rows in every fit, so they are made once."""
    base = with_bins(base, train)
    _, ready = prepared_rows(tree_pipeline(base), train, keep=("fold",))

    def judge(job: tuple[TreeParams, int]) -> float:
        p, k = job
        marked = ready.withColumn("_validation", F.col("fold") == k)
        trees = tree_pipeline(p).getStages()[-1].setValidationIndicatorCol("_validation")
        scores = score(trees.fit(marked), marked.filter("_validation"))
        return float(average_precision(scores).first()["average_precision"] or 0.0)

    tried = random_search(base, trials, seed)
    jobs = [(p, k) for p in tried for k in range(folds)]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        found = list(pool.map(inheritable_thread_target(train.sparkSession)(judge), jobs))
    means = [(p, sum(found[i * folds:(i + 1) * folds]) / folds) for i, p in enumerate(tried)]
    return max(means, key=lambda m: m[1])[0], means


@dataclass
class CalibratedEnsemble:
    """M8 result: one (base pipeline, isotonic) pair per fold."""
    members: list

    def transform(self, df: DataFrame, out: str = "churn_probability") -> DataFrame:
        acc = df
        names = []
        for i, (base, iso) in enumerate(self.members):
            raw = f"_raw_{i}"
            scored = positive_probability(base.transform(acc), raw)
            scored = scored.drop(*[c for c in scored.columns if c not in acc.columns and c != raw])
            acc = iso.setFeaturesCol(raw).setPredictionCol(f"_cal_{i}").transform(scored).drop(raw)
            names.append(f"_cal_{i}")
        mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / F.lit(float(len(names)))
        return acc.withColumn(out, mean).drop(*names)


def fit_calibrated(train: DataFrame, make_pipeline, folds: int = 3, parallelism: int = 3) -> CalibratedEnsemble:
    """M8: for each fold k: base model on the other folds, isotonic regression
    of the label on the base model's held-out probabilities, pooled in parallel
    (see ``operators.isotonic``; the function is constant outside the fitted
    range and linear between blocks).  The fold
    fits are independent Spark jobs and run concurrently (``parallelism``
    threads, as CrossValidator does), so small per-tree jobs share the
    cluster instead of queueing."""
    def fit_fold(k: int):
        fit_part = train.filter(F.col("fold") != k)
        held = train.filter(F.col("fold") == k)
        base = fit_prepared(make_pipeline(), fit_part)
        raw = positive_probability(base.transform(held), "_raw").select("_raw", LABEL)
        return base, isotonic_model(isotonic_blocks(raw, "_raw", LABEL, parts=held.rdd.getNumPartitions()), "_raw", "_cal")

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, folds))) as pool:
        members = list(pool.map(inheritable_thread_target(train.sparkSession)(fit_fold), range(folds)))
    return CalibratedEnsemble(members)
