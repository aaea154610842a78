"""Distributed isotonic calibration (M8) by pooling adjacent violators.

The increasing fit of labels on scores is the slope of the greatest convex minorant of the
cumulative diagram (rows so far, positives so far) in score order.  The minorant of the
whole is the minorant of the minorants of its parts, so parts can be pooled alone and
merged:

1. scores collapse to (score, n, positives) by an aggregate that combines map-side;
2. they are range-partitioned and sorted, and each range is pooled while it streams;
3. ranges are merged ``FAN_IN`` at a time by pooling their blocks again, until one is left.

Blocks have strictly rising rates, which are distinct fractions of counts that add up to the
number of rows N, so there are at most about 1.5 N^(2/3) of them: that bounds the last
merge and what the fitted function holds.  Rates are compared as exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapse.operators.cumulative import DEFAULT_BUCKETS
from lapse.operators.evaluate import collapse_scores

FAN_IN = 64
ROUNDING = 1e-12    # a fall below this is one of the interpolation's arithmetic
BLOCKS = "part int, low double, high double, n long, pos long"


def pooled(stack: list[list], blocks: Iterator[tuple]) -> list[list]:
    """Blocks (low, high, n, pos) in score order added to a stack of rising rates."""
    for low, high, n, pos in blocks:
        stack.append([low, high, n, pos])
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            _, high, n, pos = stack.pop()
            last = stack[-1]
            last[1], last[2], last[3] = high, last[2] + n, last[3] + pos
    return stack


def _pool_ranges(rows: DataFrame, parts: int) -> DataFrame:
    """Pool each range of blocks; rows: (low, high, n, pos)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[list] = []
        for f in frames:
            pooled(stack, zip(f["low"].tolist(), f["high"].tolist(), f["n"].tolist(), f["pos"].tolist()))
        part = TaskContext.get().partitionId()
        for at in range(0, len(stack), 10_000):
            out = pd.DataFrame(stack[at:at + 10_000], columns=["low", "high", "n", "pos"])
            out.insert(0, "part", part)
            yield out

    return rows.repartitionByRange(parts, "low").sortWithinPartitions("low").mapInPandas(run, BLOCKS)


def isotonic_blocks(df: DataFrame, score: str = "churn_probability", label: str = "is_churn", parts: int | None = None) -> DataFrame:
    """Pooled blocks (low, high, n, pos, rate) of the increasing fit, in score order within the
    one partition that the last merge leaves; rows without a score or label take no part.
    ``parts`` ranges are pooled at first, by default as many as the session's shuffles have."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = collapse_scores(df, score, label).select(F.col("score").alias("low"), F.col("score").alias("high"), "n", "pos")
    while True:
        rows = _pool_ranges(rows, parts).drop("part")
        if parts == 1:
            return rows.select("low", "high", "n", "pos", (F.col("pos") / F.col("n")).alias("rate"))
        parts = -(-parts // FAN_IN)


def isotonic_model(blocks: DataFrame, features_col: str = "_raw", prediction_col: str = "_cal") -> IsotonicRegressionModel:
    """The fitted function as an MLlib model: linear between the blocks' ends and constant
    beyond.  Only the ends of the pooled blocks go into it, weighted by their rows."""
    ends = F.when(F.col("low") == F.col("high"), F.array("low")).otherwise(F.array("low", "high"))
    points = blocks.select(F.explode(ends).alias(features_col), F.col("rate").alias("_rate"),
                           (F.col("n").cast("double") / F.size(ends)).alias("_weight"))
    return IsotonicRegression(featuresCol=features_col, labelCol="_rate", weightCol="_weight",
                              predictionCol=prediction_col, isotonic=True).fit(points)


def calibrated_scores(df: DataFrame, score: str = "churn_probability", label: str = "is_churn") -> DataFrame:
    """(score, n, pos, calibrated) per distinct score: the fitted function at that score."""
    model = isotonic_model(isotonic_blocks(df, score, label), "score", "calibrated")
    return model.transform(collapse_scores(df, score, label)).select("score", "n", "pos", "calibrated")


def _compared(rows: DataFrame, *by: str) -> DataFrame:
    """Rows (at, low, high, falls, in_range) of one ``by`` range as one row; it falls where any of
    them lies below one before it."""
    before = F.max("high").over(Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    falls = F.col("falls") | F.coalesce(before > F.col("low") + ROUNDING, F.lit(False))
    return rows.withColumn("falls", falls).groupBy(*by).agg(
        F.min("at").alias("at"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.bool_or("falls").alias("falls"), F.bool_and("in_range").alias("in_range"))


def order_checks(df: DataFrame, score: str = "_raw", calibrated: str = "_cal", buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """One row (never_falls, in_range): whether the value at every distinct score is at least that at
    every lower one, and whether each value lies in [0, 1] (a missing one doesn't).  Scores are compared
    within value ranges, these within ``buckets`` coarse ranges, and at last the coarse ranges."""
    c = F.col(calibrated)
    rows = df.groupBy(F.col(score).alias("at")).agg(F.min(c).alias("low"), F.max(c).alias("high"), F.lit(False).alias("falls"),
                                                    F.bool_and(F.coalesce(c.between(0, 1), F.lit(False))).alias("in_range"))
    n_fine = float(buckets * buckets)
    fine = F.floor(F.least(F.greatest(F.col("at") * n_fine, F.lit(0.0)), F.lit(n_fine - 1)))
    ranges = _compared(rows.withColumn("range", fine), "range")
    coarse = _compared(ranges.withColumn("range", F.floor(F.col("range") / buckets)), "range")
    return _compared(coarse).select((~F.col("falls")).alias("never_falls"), "in_range")    # at most `buckets` rows
