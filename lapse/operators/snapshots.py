"""Listening aggregates at many reference dates (A1-A6, FB4) from daily partial states.

``daily_states`` reduces the log once to mergeable states per customer and day: rows, songs,
distinct-song counts, seconds.  They can be kept as a table and added to day by day (merging
two states of one day is adding them up).  ``aggregate_snapshots`` merges them for all dates
at once: a state goes to each date whose windows hold its day, and to the first date that
sees it, so with monthly dates and 30-day windows a state is used once or twice, and
twelve snapshots cost about what one does.  Window sums are sums of the window's own
days, not differences of running totals, so they lose no digits.

A customer has at most one state per day; the last window runs over a customer's at most
len(dates) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.config import FeatureConfig
from lapse.functions.dates import date_lit
from lapse.operators.features import _engagement_select, _trend_select

STATE_SUMS = ("songs", "unq", "secs")


def daily_states(logs: DataFrame, key: str = "msno", date_col: str = "log_date") -> DataFrame:
    """(key, log_date, n, songs, unq, secs): one mergeable state per customer and day with a date."""
    return (logs.where(F.col(date_col).isNotNull()).groupBy(key, F.col(date_col).alias("log_date"))
            .agg(F.count(F.lit(1)).alias("n"),
                 *(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(name)
                   for name, c in zip(STATE_SUMS, ("num_100", "num_unq", "total_secs")))))


def merge_states(*tables: DataFrame, key: str = "msno") -> DataFrame:
    """States of several tables (an older one and new days, several sources) as one table."""
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t)
    return union.groupBy(key, "log_date").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in STATE_SUMS))


def _spans(cfg: FeatureConfig) -> dict[str, tuple[int, int]]:
    """Window name to its least and greatest age in days."""
    r, p = cfg.trend_window_recent, cfg.trend_window_prior
    return {str(w): (0, w) for w in cfg.windows_days} | {"recent": (0, r), "prior": (r + 1, r + p)}


def aggregate_snapshots(states: DataFrame, reference_dates: list, cfg: FeatureConfig = FeatureConfig(), key: str = "msno") -> DataFrame:
    """(key, reference_date, ...) with the columns of :func:`lapse.operators.logs.aggregate_logs`:
    for every date, the customers with a log row on or before it."""
    dates = sorted({str(d) for d in reference_dates})
    if not dates:
        raise ValueError("no reference dates")
    spans = _spans(cfg)
    widest = max(hi for _, hi in spans.values())
    lits = F.array(*(date_lit(d) for d in dates))
    last = len(dates)

    def age(i: Column) -> Column:
        return F.datediff(F.element_at(lits, i + 1), F.col("log_date"))

    first = F.size(F.filter(lits, lambda r: r < F.col("log_date")))
    seen = states.withColumn("_first", first).where(F.col("_first") < last)
    seen = seen.withColumn("_i", F.explode(F.filter(F.sequence("_first", F.lit(last - 1)),
                                                    lambda i: (i == F.col("_first")) | (age(i) <= widest))))
    days = age(F.col("_i"))
    sums = {}
    for name, (lo, hi) in spans.items():
        held = days.between(lo, hi)
        sums[f"_n_{name}"] = F.sum(F.when(held, F.col("n")).otherwise(F.lit(0)))
        for c in STATE_SUMS:
            sums[f"_{c}_{name}"] = F.sum(F.when(held, F.col(c)).otherwise(F.lit(0.0)))
    per = seen.groupBy(key, "_i").agg(F.max("log_date").alias("_last"), *(v.alias(k) for k, v in sums.items()))
    line = Window.partitionBy(key).orderBy("_i")
    per = per.withColumns({"_last": F.max("_last").over(line.rowsBetween(Window.unboundedPreceding, 0)),
                           "_next": F.coalesce(F.lead("_i").over(line), F.lit(last))})
    # Dates up to the next one with states of its own see the same last day and empty windows.
    per = per.withColumn("_at", F.explode(F.sequence("_i", F.col("_next") - 1)))
    own = F.col("_at") == F.col("_i")

    def mean(c: str, name: str) -> Column:
        return F.when(own, F.try_divide(F.col(f"_{c}_{name}"), F.col(f"_n_{name}")))

    out = [F.col(key), F.element_at(lits, F.col("_at") + 1).alias("reference_date"),
           F.datediff(F.element_at(lits, F.col("_at") + 1), F.col("_last")).alias("days_since_last_log")]
    for w in cfg.windows_days:
        out += [F.when(own, F.col(f"_n_{w}")).otherwise(F.lit(0)).cast("long").alias(f"active_days_{w}"),
                mean("songs", str(w)).alias(f"avg_songs_100_{w}"), mean("secs", str(w)).alias(f"avg_secs_{w}")]
        if w in cfg.unq_windows:
            out.append(mean("unq", str(w)).alias(f"avg_unq_{w}"))
    out += [mean(c, name).alias(f"{name}_avg_{c}") for name in ("recent", "prior") for c in ("secs", "songs")]
    return per.select(*out)


def engagement_snapshots(states: DataFrame, base: DataFrame, reference_dates: list, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """FB4 at every date: (msno, reference_date, engagement features) for each base customer, with
    the sentinels of :func:`lapse.operators.features.build_engagement_features`."""
    dates = F.array(*(date_lit(d) for d in sorted({str(d) for d in reference_dates})))
    asked = base.select("msno", F.explode(dates).alias("reference_date"))
    joined = asked.join(aggregate_snapshots(states, reference_dates, cfg), ["msno", "reference_date"], "left")
    filled = joined.select("msno", "reference_date", *_engagement_select(cfg))
    return filled.select("*", *_trend_select(cfg))
