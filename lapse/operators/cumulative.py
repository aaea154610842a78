"""Exact running totals over a global order, without a one-partition window.

A window with ``orderBy`` and no ``partitionBy`` moves every row into one
task.  Instead the first order column is cut into value ranges, two levels
deep so that no range holds a large share of the rows unless the values are
packed into 1 / buckets^2 of their span:

1. fine bucket = floor((x - lo) / (hi - lo) * buckets^2); coarse = fine // buckets;
2. per-fine-bucket totals: one aggregate (combined map-side);
3. the exclusive prefix of each fine bucket = prefix within its coarse bucket
   (a window over at most ``buckets`` rows) + prefix of the coarse totals (a
   window over at most ``buckets`` rows per group, broadcast if there are no
   groups); grand totals ride along;
4. each row: running sum inside its fine bucket (window partitioned by the
   fine bucket) + the fine bucket's offset, joined on the same key, so the
   data itself is shuffled once.

lo/hi are literals when the range is known (probabilities, hashes), else the
min/max of each group from one small aggregate (one row per group; ``by`` is
meant for few groups such as classes or profiled columns).  Rows are ordered
by all ``order_cols``; give a unique order (ties would get an arbitrary but
consistent position).  Callers collapse duplicate values first with an
aggregate that combines map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKETS = 4096


def running_totals(df: DataFrame, order_cols: str | list[str], sum_cols: list[str], descending: bool = False,
                   by: list[str] | None = None, buckets: int = DEFAULT_BUCKETS,
                   lo: float | None = None, hi: float | None = None, with_totals: bool = False) -> DataFrame:
    """Add ``cum_<c>``: the sum of ``c`` over every row of the same ``by``
    group at or before this row in ``order_cols`` order (ascending, or
    descending); with ``with_totals`` also ``total_<c>`` of the group."""
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    by = list(by or [])
    x = F.col(order_cols[0]).cast("double")
    if lo is not None and hi is not None:
        ranged = df.withColumns({"_lo": F.lit(float(lo)), "_hi": F.lit(float(hi))})
    else:
        rng = df.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))   # one row per group
        if by:
            # One row per group, always broadcast: a shuffle by a handful of groups would put a whole group into one task.
            ranged = df.join(F.broadcast(rng), by, "inner")
        else:   # scalar subqueries over one aggregate (merged into one by the optimizer)
            ranged = df.withColumns({"_lo": rng.select("_lo").scalar(), "_hi": rng.select("_hi").scalar()})
    n_fine = buckets * buckets
    frac = F.coalesce(F.try_divide(x - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    fine = F.least(F.greatest(F.floor(frac * F.lit(float(n_fine))), F.lit(0)), F.lit(n_fine - 1)).cast("long")
    if descending:
        fine = F.lit(n_fine - 1) - fine
    keyed = ranged.withColumn("_fine", fine).drop("_lo", "_hi")

    fine_tot = (keyed.groupBy(*by, "_fine").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
                     .withColumn("_coarse", F.floor(F.col("_fine") / F.lit(buckets)).cast("long")))
    coarse_tot = fine_tot.groupBy(*by, "_coarse").agg(*[F.sum(f"_t_{c}").alias(f"_ct_{c}") for c in sum_cols])
    c_before = Window.partitionBy(*by).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    c_cols = [F.coalesce(F.sum(f"_ct_{c}").over(c_before), F.lit(0)).alias(f"_co_{c}") for c in sum_cols]
    if with_totals:
        c_cols += [F.sum(f"_ct_{c}").over(Window.partitionBy(*by)).alias(f"total_{c}") for c in sum_cols]
    coarse_off = coarse_tot.select(*by, "_coarse", *c_cols)          # <= buckets rows per group

    f_before = Window.partitionBy(*by, "_coarse").orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
    # Without groups the offsets are at most `buckets` rows; with them Spark goes by their size.
    fine_off = (fine_tot.join(coarse_off if by else F.broadcast(coarse_off), [*by, "_coarse"], "inner")
                        .select(*by, "_fine",
                                *[(F.coalesce(F.sum(f"_t_{c}").over(f_before), F.lit(0)) + F.col(f"_co_{c}"))
                                  .alias(f"_o_{c}") for c in sum_cols],
                                *([F.col(f"total_{c}") for c in sum_cols] if with_totals else [])))

    order = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    within = Window.partitionBy(*by, "_fine").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.join(fine_off, [*by, "_fine"], "inner")
    extra = [F.col(f"total_{c}") for c in sum_cols] if with_totals else []
    return out.select(*df.columns, *[(F.sum(c).over(within) + F.col(f"_o_{c}")).alias(f"cum_{c}")
                                     for c in sum_cols], *extra)
