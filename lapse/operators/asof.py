"""As-of joins (J12) by a tagged union with values carried along each key's time line.

Both tables become rows of one time line per key; for a row of the left table the last
value before it and the first value after it are its matches.  The line is worked on in
buckets of time, so that no window holds a whole key:

1. per (key, bucket) the last and the first known value: one aggregate that combines map-side;
2. a window over a key's buckets (their number is bounded by the calendar) carries the
   values from the buckets before and after in;
3. a window inside each (key, bucket) does the rest.

A key that holds a third of all rows is thereby dealt out by its buckets, and the join that
brings the carried values back is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(df: DataFrame, key: str, order: list[str], bucket: str, before: list[str], after: list[str]) -> DataFrame:
    """``df`` with, per row, ``before_<c>``: the last non-null ``c`` of its key at or before it in
    ``order``, and ``after_<c>``: the first non-null one strictly after it.  ``bucket`` is a column
    that rises with ``order``; null buckets aren't allowed."""
    at = F.struct(*order)

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), at)

    per = df.groupBy(key, bucket).agg(*(F.max_by(c, known(c)).alias(f"_l_{c}") for c in before),
                                      *(F.min_by(c, known(c)).alias(f"_f_{c}") for c in after))
    line = Window.partitionBy(key).orderBy(bucket)
    earlier, later = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    carry = per.select(F.col(key).alias("_key"), F.col(bucket).alias("_bucket"),
                       *(F.last(f"_l_{c}", ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in before),
                       *(F.first(f"_f_{c}", ignorenulls=True).over(later).alias(f"_out_{c}") for c in after))
    inside = Window.partitionBy(key, bucket).orderBy(*order)
    past, future = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(1, Window.unboundedFollowing)
    joined = df.join(carry, (F.col(key) == F.col("_key")) & (F.col(bucket) == F.col("_bucket")), "left")
    return joined.select(*(F.col(c) for c in df.columns),
                         *(F.coalesce(F.last(c, ignorenulls=True).over(past), F.col(f"_in_{c}")).alias(f"before_{c}") for c in before),
                         *(F.coalesce(F.first(c, ignorenulls=True).over(future), F.col(f"_out_{c}")).alias(f"after_{c}") for c in after))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str],
              ties: list[Column] | None = None, direction: str = "backward") -> DataFrame:
    """Each left row with ``values`` of its key's right row of the latest ``right_at`` at or before
    ``left_at`` (backward), or of the earliest one strictly after it (forward); NULLs where there
    is none.  Of several right rows of one key and time the greatest in ``ties`` counts
    (ties there: the greatest values).  Rows with a null key or time match nothing.

    Right rows are reduced to one per key and time, and left rows to their distinct key and
    time, before the union; both combine map-side, so repeated rows don't add up."""
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction is backward or forward, not {direction}")
    state = F.struct(*(F.col(v).alias(v) for v in values))
    known = (right.where(F.col(key).isNotNull() & F.col(right_at).isNotNull())
             .groupBy(F.col(key).alias("_k"), F.col(right_at).alias("_at"))
             .agg(F.max_by(state, F.struct(*(c.alias(f"_{i}") for i, c in enumerate(ties or [])), state.alias("_all"))).alias("_v")))
    asked = left.select(F.col(key).alias("_k"), F.col(left_at).alias("_at")).where("_k is not null and _at is not null").distinct()
    union = (known.withColumn("_tag", F.lit(0))
             .unionByName(asked.withColumn("_tag", F.lit(1)), allowMissingColumns=True)
             .withColumn("_month", F.trunc(F.col("_at").cast("date"), "month")))
    backward = direction == "backward"
    lined = carried(union, "_k", ["_at", "_tag"], "_month", ["_v"] if backward else [], [] if backward else ["_v"])
    found = lined.where("_tag = 1").select("_k", F.col("_at").alias("_when"), F.col("before__v" if backward else "after__v").alias("_match"))
    out = left.join(found, (left[key] == found["_k"]) & (left[left_at] == found["_when"]), "left")
    return out.select(*(left[c] for c in left.columns), *(F.col("_match")[v].alias(v) for v in values))
