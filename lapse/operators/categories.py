"""Category frequency (A10) and rare-category rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_VALUES = 100_000


def category_frequency(df: DataFrame, col: str) -> DataFrame:
    """A10: share of each non-null value among the non-null rows.

    The counts are one aggregate (combined map-side); the non-null total is a
    scalar subquery (a one-row aggregate evaluated once), so no join is needed.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.col(col))).scalar()
    return counts.select(col, "n", (F.col("n") / total).alias("freq"))


def frequent_values(df: DataFrame, col: str, min_freq: float) -> DataFrame:
    """Values of ``col`` with frequency >= ``min_freq``: at most 1/min_freq of them."""
    return (category_frequency(df, col)
            .filter(F.col("freq") >= F.lit(float(min_freq)))
            .select(F.col(col).alias("_kept")))


def rollup_rare(df: DataFrame, col: str, population: DataFrame, min_freq: float,
                out: str | None = None) -> DataFrame:
    """NULL -> 'Unknown'; frequent code -> its integer text; else 'Other'.

    Frequencies are computed over ``population`` (e.g. all members, not the
    cohort).  The kept list has at most ``1/min_freq`` rows; where that is a
    small number it is broadcast, else the join is left to Spark.
    """
    out = out or f"{col}_clean"
    kept = frequent_values(population, col, min_freq)
    if min_freq > 0 and 1 / min_freq <= BROADCAST_VALUES:
        kept = F.broadcast(kept)
    joined = df.join(kept, df[col] == kept["_kept"], "left")
    label = (F.when(F.col(col).isNull(), F.lit("Unknown"))
              .when(F.col("_kept").isNotNull(), F.col(col).cast("long").cast("string"))
              .otherwise(F.lit("Other")))
    return joined.withColumn(out, label).drop("_kept")
