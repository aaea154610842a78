"""Mergeable sketches for distinct counts and quantiles (A7, A24, A25, A26 at scale).

``sketch_states`` reduces a table to one state per segment and column: row counts, an HLL
sketch of the values and, for numbers, a KLL sketch, of fixed size each.  States are kept as a
table and merged for any union of segments (``merged_states``) without another look at the
rows; the exact forms stay in ``profile`` and ``evaluate``.  Partial aggregation makes a
segment with a third of the rows one state per task before the shuffle.

Bounds: a distinct count is within ``DISTINCT_ERROR`` (four standard errors of 2^12 registers),
the rank of a quantile's value within ``RANK_ERROR`` of the asked rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_REGISTERS, KLL_K = 12, 400
DISTINCT_ERROR, RANK_ERROR = 4 * 1.04 / 64, 0.015


def _numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def sketch_states(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., column, n, n_null, distinct_sketch, quantile_sketch); the quantile sketch is null for
    columns that aren't numbers."""
    by = by or []
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"_n{i}"), F.count_if(F.col(c).isNull()).alias(f"_z{i}"),
                 F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LOG_REGISTERS)).alias(f"_d{i}"),
                 (F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_K)) if _numeric(df, c)
                  else F.lit(None).cast("binary")).alias(f"_q{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n"), F.col(f"_z{i}").alias("n_null"),
                              F.col(f"_d{i}").alias("distinct_sketch"), F.col(f"_q{i}").alias("quantile_sketch"))
                     for i, c in enumerate(columns)))
    return wide.select(*by, F.inline(rows))


def merged_states(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """States of coarser segments (by default of everything), merged from finer ones."""
    return states.groupBy(*(by or []), "column").agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.when(F.count("quantile_sketch") > 0, F.kll_merge_agg_double("quantile_sketch")).alias("quantile_sketch"))


def distinct_counts(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., column, n, n_null, n_distinct): estimated distinct values."""
    return states.select(*(by or []), "column", "n", "n_null", F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"))


def quantiles(states: DataFrame, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., column, prob, value): a value of about that rank, for columns of numbers with a value."""
    each = F.array(*(F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(p))).alias("value"))
                     for p in probs))
    return states.where("quantile_sketch is not null and n > 0").select(*(by or []), "column", F.inline(each))


def rank_errors(df: DataFrame, found: DataFrame) -> DataFrame:
    """(column, prob, value, error): how far each quantile's true rank range lies from ``prob``,
    by counting the table's rows below and up to the value in one pass; ``found`` (column,
    prob, value) is one row per column and asked rank."""
    columns = [c for c in df.columns if _numeric(df, c)]
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns)))).where("x is not null")
    counts = long.groupBy("column", "x").agg(F.count(F.lit(1)).alias("k"))
    joined = counts.join(found, "column")
    per = joined.groupBy("column", "prob", "value").agg(
        F.sum("k").alias("n"), F.sum(F.when(F.col("x") < F.col("value"), F.col("k")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("x") <= F.col("value"), F.col("k")).otherwise(0)).alias("upto"))
    low, high = F.col("below") / F.col("n"), F.col("upto") / F.col("n")
    return per.select("column", "prob", "value", F.greatest(low - F.col("prob"), F.col("prob") - high, F.lit(0.0)).alias("error"))
