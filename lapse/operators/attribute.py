"""Feature attribution and driver-based actions.

Per-row contributions are arrays computed with column expressions, so top-n
drivers are an ``array_sort`` + ``slice`` inside each row: no shuffle, no
per-customer grouping.  Global drivers are one aggregate over the long form.

* Linear models (X1 step 1): contribution_j = w_j * (x_j - E[x_j]) summed over
  the design columns of each original feature; base + sum(contributions)
  equals the model margin (log-odds) exactly.
* Tree models (X1 step 2): ``lapse.operators.treeshap``.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoderModel, StandardScalerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse import config as C
from lapse.functions.clean import direction, driver_text


def _contrib_struct(names: list[str], values: list[Column]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(i).alias("pos"), v.cast("double").alias("contribution"))
                     for i, (n, v) in enumerate(zip(names, values))])


def _sums_by_index(weights: list[float], means: list[float]) -> list[float]:
    """Sum of w_j * ((j == i) - m_j), added in column order, for every index i of a one-hot
    block; the last index (unseen values) has no column of its own."""
    terms = np.tile(np.array(weights) * (0.0 - np.array(means)), (len(weights) + 1, 1))
    np.fill_diagonal(terms, np.array(weights) * (1.0 - np.array(means)))
    return functools.reduce(np.add, terms.T, np.zeros(len(weights) + 1)).tolist()


def linear_contributions(model: PipelineModel, df: DataFrame, reference: DataFrame,
                         features: tuple[str, ...] = C.MODEL_FEATURES, key: str = "msno") -> DataFrame:
    """X1 (linear): ``contributions`` array<struct<feature, pos, contribution>>
    in model-feature order, plus ``base_value``, for every row of ``df``.

    E[x] is the mean design vector of ``reference`` (e.g. the training rows):
    a one-row aggregate whose size is the model width, not the data size.
    """
    stages = model.stages
    lr = next(s for s in stages if isinstance(s, LogisticRegressionModel))
    ohe = next(s for s in stages if isinstance(s, OneHotEncoderModel))
    scaler = next(s for s in stages if isinstance(s, StandardScalerModel))
    cats = [c for c in features if c in C.CATEGORICAL_FEATURES]
    nums = [c for c in features if c not in C.CATEGORICAL_FEATURES]
    # design column -> original feature (scaled numerics first, then one-hot blocks)
    owner = list(nums)
    for c, size in zip(cats, ohe.categorySizes):
        owner += [c] * (size - 1)          # dropLast=True
    weights = lr.coefficients.toArray().tolist()
    if len(owner) != len(weights):
        raise ValueError(f"design width {len(weights)} does not match feature layout {len(owner)}")
    design = model.transform(reference).select(Summarizer.mean(F.col(lr.getFeaturesCol())).alias("m"))
    means = design.first()["m"].toArray().tolist()
    base = float(lr.intercept) + sum(w * m for w, m in zip(weights, means))

    # w_j * (x_j - E[x_j]) straight from the scaled numerics; a categorical's sum over its
    # one-hot columns only depends on its index, so it is looked up (one value per index)
    values = {f: F.lit(weights[j]) * (F.col("_z")[j] - F.lit(means[j])) for j, f in enumerate(nums)}
    start = len(nums)
    for c, idx, size in zip(cats, ohe.getInputCols(), ohe.categorySizes):
        w, m = weights[start:start + size - 1], means[start:start + size - 1]
        sums = _sums_by_index(w, m)
        values[c] = F.element_at(F.array(*[F.lit(v) for v in sums]), F.col(idx).cast("int") + 1)
        start += size - 1
    scored = model.transform(df).withColumn("_z", vector_to_array(F.col(scaler.getOutputCol())))
    per_feature = [values.get(f, F.lit(0.0)) for f in features]
    keep = [c for c in (key, "is_churn") if c in df.columns]
    return scored.select(*keep, _contrib_struct(list(features), per_feature).alias("contributions"),
                         F.lit(base).alias("base_value"))


def standin_weights(features: tuple[str, ...] = C.MODEL_FEATURES) -> dict[str, float]:
    """A deterministic linear stand-in model over the numeric features (rule:
    w_i = ((i mod 7) - 3) / 10 by feature position) so that attribution,
    drivers and actions can be checked against SQL before a model exists."""
    return {f: ((i % 7) - 3) / 10.0 for i, f in enumerate(features) if f not in C.CATEGORICAL_FEATURES}


def standin_contributions(df: DataFrame, weights: dict[str, float] | None = None, key: str = "msno") -> DataFrame:
    """Contributions w_f * x_f of the stand-in linear model against an all-zero
    baseline (a centred baseline would make every global mean exactly zero, so
    the global direction would be rounding noise)."""
    weights = weights or standin_weights()
    names = list(weights)
    vals = [F.lit(weights[f]) * F.col(f).cast("double") for f in names]
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, _contrib_struct(names, vals).alias("contributions"))


def top_drivers(contributions: Column, n: int = 3) -> Column:
    """K8: the n largest |contribution| (ties by feature position), as
    array<struct<feature, pos, contribution>>."""
    def cmp(a, b):
        aa, bb = F.abs(a["contribution"]), F.abs(b["contribution"])
        return (F.when(aa > bb, F.lit(-1)).when(aa < bb, F.lit(1))
                 .when(a["pos"] < b["pos"], F.lit(-1)).when(a["pos"] > b["pos"], F.lit(1)).otherwise(F.lit(0)))
    return F.slice(F.array_sort(contributions, cmp), 1, n)


def driver_strings(drivers: Column) -> Column:
    """X2 output form: 'name (High|Low)' per driver."""
    return F.transform(drivers, lambda d: driver_text(d["feature"], d["contribution"]))


def retention_action(tier: Column, drivers: Column) -> Column:
    """Low -> no action; Medium -> engagement email; High -> the action of
    the first risk-raising driver (importance order) found in the payment,
    renewal or price families, else the targeted offer."""
    def family(f: Column) -> Column:
        return (F.when(f.isin(*C.PAYMENT_FRICTION), F.lit(C.ACTION_PAYMENT))
                 .when(f.isin(*C.RENEWAL_TIMING), F.lit(C.ACTION_RENEWAL))
                 .when(f.isin(*C.PRICE_SENSITIVITY), F.lit(C.ACTION_DISCOUNT)))
    raising = F.filter(drivers, lambda d: d["contribution"] > 0)
    actions = F.filter(F.transform(raising, lambda d: family(d["feature"])), lambda a: a.isNotNull())
    first = F.try_element_at(actions, F.lit(1))
    return (F.when(tier == "Low", F.lit(C.ACTION_LOW))
             .when(tier == "Medium", F.lit(C.ACTION_MEDIUM))
             .otherwise(F.coalesce(first, F.lit(C.ACTION_FALLBACK_HIGH))))


def retention_action_from_text(tier: Column, driver_texts: Column) -> Column:
    """B3 on 'name (High|Low)' strings (F7 parse first)."""
    parsed = F.transform(driver_texts, lambda s: F.struct(
        F.regexp_extract(s, r"^(.*) \((High|Low)\)$", 1).alias("feature"),
        F.when(F.regexp_extract(s, r"^(.*) \((High|Low)\)$", 2) == "High", F.lit(1.0)).otherwise(F.lit(-1.0))
         .alias("contribution")))
    return retention_action(tier, parsed)   # NULL drivers -> NULL list -> fallback


def contributions_long(df: DataFrame, key: str = "msno") -> DataFrame:
    """Long form (key, feature, contribution).  The outer form, without its rows for empty
    arrays: a plain ``inline`` puts a filter on the array's size below itself, which works
    all contributions out twice."""
    return df.select(key, F.inline_outer("contributions")).where(F.col("pos").isNotNull()).drop("pos")


def global_drivers(long_df: DataFrame, top: int | None = 15) -> DataFrame:
    """Mean |contribution| as impact, 'High' if the mean is positive,
    sorted by impact (top ``top``, the report size)."""
    g = long_df.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("impact"),
                                       F.avg("contribution").alias("mean_contribution"))
    g = g.select("feature", "impact", direction("mean_contribution").alias("direction"))
    g = g.orderBy(F.col("impact").desc(), F.col("feature"))
    return g.limit(top) if top else g


def impact_share_of_max(drivers: DataFrame) -> DataFrame:
    """Impact as a fraction of the largest impact (a <= 31-row table)."""
    return drivers.withColumn("share_of_max", F.col("impact") / F.max("impact").over(Window.partitionBy()))
