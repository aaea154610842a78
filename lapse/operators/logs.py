"""Per-customer listening-log aggregates.

All windows are conditional aggregates of ONE ``groupBy`` over the log scan:
Spark runs a partial hash aggregate before the shuffle, so the shuffle
carries one row per (map task, customer) whatever the skew, and a hot
customer never lands in one task as raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.config import FeatureConfig
from lapse.functions.dates import date_lit


def _windowed_avg(value: str, cond: Column) -> Column:
    return F.try_divide(
        F.sum(F.when(cond, F.col(value)).otherwise(F.lit(0))).cast("double"),
        F.count(F.when(cond, F.lit(1))),
    )


def days_ago(reference_date, date_col: str = "log_date") -> Column:
    return F.datediff(date_lit(reference_date), F.col(date_col))


def aggregate_logs(logs: DataFrame, reference_date, cfg: FeatureConfig = FeatureConfig(),
                   key: str = "msno", date_col: str = "log_date") -> DataFrame:
    """Whole per-customer log aggregate at ``reference_date``.

    * rows after the reference date are ignored (P1; pushed into the scan where
      ``log_date`` is a stored column);
    * ``days_since_last_log`` = min days ago (A1);
    * for each window w: rows with days_ago <= w (w+1 calendar days, rows not
      distinct days) counted (A2) and averaged (A3, NULL for an empty window);
    * recent (<= r) vs prior (r < days_ago <= r+p) averages (A4).
    """
    d = days_ago(reference_date, date_col)
    filtered = (logs.filter(F.col(date_col) <= date_lit(reference_date))
                    .select(F.col(key), d.alias("days_ago"), "num_100", "num_unq", "total_secs"))
    da = F.col("days_ago")
    aggs: list[Column] = [F.min(da).alias("days_since_last_log")]
    for w in cfg.windows_days:
        cond = da <= F.lit(w)
        aggs += [
            F.count(F.when(cond, F.lit(1))).alias(f"active_days_{w}"),
            _windowed_avg("num_100", cond).alias(f"avg_songs_100_{w}"),
            _windowed_avg("total_secs", cond).alias(f"avg_secs_{w}"),
        ]
        if w in cfg.unq_windows:
            aggs.append(_windowed_avg("num_unq", cond).alias(f"avg_unq_{w}"))
    r, p = cfg.trend_window_recent, cfg.trend_window_prior
    recent = da <= F.lit(r)
    prior = (da > F.lit(r)) & (da <= F.lit(r + p))
    aggs += [
        _windowed_avg("total_secs", recent).alias("recent_avg_secs"),
        _windowed_avg("num_100", recent).alias("recent_avg_songs"),
        _windowed_avg("total_secs", prior).alias("prior_avg_secs"),
        _windowed_avg("num_100", prior).alias("prior_avg_songs"),
    ]
    return filtered.groupBy(key).agg(*aggs)


def lifetime_log_stats(logs: DataFrame, key: str = "msno") -> DataFrame:
    """Per-customer lifetime stats (rows, sums of num_25 / num_100, avg secs)."""
    return logs.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_log_days"),
        F.sum("num_25").cast("long").alias("total_num_25"),
        F.sum("num_100").cast("long").alias("total_num_100"),
        F.avg("total_secs").alias("avg_daily_secs"),
    )
