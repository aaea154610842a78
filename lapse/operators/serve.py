"""Lookup-style queries over the scored table.

The serving layer of a dashboard becomes DataFrame functions: a point lookup
is an equality filter (Parquet min/max statistics skip row groups when the
table is written sorted by ``msno``), a batch lookup is a join, and a what-if
is a join of a scenario table followed by the same scoring expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapse.config import BusinessConfig, RiskThresholds, ServeConfig
from lapse.operators.value import estimated_clv, expected_value, low_confidence, risk_tier

PROFILE_COLUMNS = ("msno", "city", "gender", "age_clean", "registered_via_clean", "plan_list_price",
                   "payment_plan_days", "is_auto_renew", "days_since_registration")
PREDICTION_COLUMNS = ("churn_probability", "risk_tier", "estimated_clv", "expected_value", "low_confidence")
NOT_FOUND = "Customer not found"
SCENARIO_FIELDS = ("plan_list_price", "payment_plan_days", "is_auto_renew", "days_since_registration")


def customer_profile(df: DataFrame, msno: str) -> DataFrame:
    """The profile row of one customer; an empty result means not found."""
    return df.filter(F.col("msno") == F.lit(msno)).select(*PROFILE_COLUMNS)


def search_ids(df: DataFrame, query: str = "", limit: int = 10) -> DataFrame:
    """Case-insensitive substring search over ids, first ``limit`` by id."""
    ids = df.select("msno")
    if query:
        ids = ids.filter(F.lower(F.col("msno")).contains(query.lower()))
    return ids.orderBy("msno").limit(limit)


def url_safe_ids(df: DataFrame, limit: int = 50) -> DataFrame:
    """P10: ids without '/', first ``limit`` by id."""
    return df.select("msno").filter(~F.col("msno").contains("/")).orderBy("msno").limit(limit)


def hash_order(seed: int, key: str = "msno") -> Column:
    """Deterministic pseudo-random order: md5 of (key, seed).  Unlike
    ``sample`` it does not change with partitioning, and SQL engines can
    reproduce it."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def seeded_sample(df: DataFrame, n: int = 50, seed: int = 42, key: str = "msno") -> DataFrame:
    """K6 / K7: ``n`` rows in seeded hash order (bounded top-k, no shuffle of the table)."""
    return df.orderBy(hash_order(seed, key), F.col(key)).limit(n)


def batch_requests(spark: SparkSession, msno_list: list[str], max_batch: int = ServeConfig().max_batch_size) -> DataFrame:
    """J11 request side: validate size before planning, keep order and duplicates."""
    if not msno_list:
        raise ValueError("Empty msno list")
    if len(msno_list) > max_batch:
        raise ValueError(f"Batch size exceeds maximum of {max_batch}")
    return spark.createDataFrame([(0, i, m) for i, m in enumerate(msno_list)],
                                 "request_id long, pos int, msno string")


def batch_lookup(requests: DataFrame, scored: DataFrame) -> DataFrame:
    """Requested ids (request_id, pos, msno) left-joined to the scored table.

    Unknown ids give success = false, 'Customer not found' and NULL metrics.
    The scored side is keyed by ``msno``; the requests are a small side, but the
    join is left to the planner (AQE turns it into a broadcast join at run
    time when the request table is measured small).
    """
    right = scored.select("msno", *PREDICTION_COLUMNS).withColumn("_hit", F.lit(True))
    j = requests.join(right, "msno", "left")
    hit = F.col("_hit").isNotNull()
    return j.select(
        "request_id", "pos", "msno", hit.alias("success"),
        F.when(hit, F.lit(None).cast("string")).otherwise(F.lit(NOT_FOUND)).alias("error_message"),
        *PREDICTION_COLUMNS)


def usage_history(logs: DataFrame, msno: str | None = None) -> DataFrame:
    """K5: daily usage rows with ``day_no`` (1, 2, ... in date order per customer),
    ``yyyy-MM-dd`` text, secs double, unq int.  With ``msno`` one customer; without, every
    customer, never collected into one row per customer.

    Rows are numbered inside each customer's month, and the number of rows in the months
    before is added: a mergeable count per customer and month, prefixed over months.  A
    customer with a third of all rows is dealt out by months, and the join that adds
    the prefixes is one that Spark can split."""
    if msno is not None:
        logs = logs.filter(F.col("msno") == F.lit(msno))
    undated = F.lit("0001-01-01").cast("date")
    rows = logs.select("msno", "log_date", F.col("total_secs").cast("double").alias("total_secs"),
                       F.col("num_unq").cast("int").alias("num_unq"),
                       F.coalesce(F.trunc("log_date", "month"), undated).alias("_month"))
    months = Window.partitionBy("msno").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    before = (rows.groupBy("msno", "_month").agg(F.count(F.lit(1)).alias("_n"))
              .select(F.col("msno").alias("_id"), F.col("_month").alias("_of"), F.coalesce(F.sum("_n").over(months), F.lit(0)).alias("_before")))
    by_day = Window.partitionBy("msno", "_month").orderBy(F.col("log_date").asc_nulls_first(), "total_secs", "num_unq")
    return (rows.join(before, F.col("msno").eqNullSafe(F.col("_id")) & (F.col("_month") == F.col("_of")))
                .withColumn("day_no", (F.row_number().over(by_day) + F.col("_before")).cast("int"))
                .select("msno", "day_no", F.date_format("log_date", "yyyy-MM-dd").alias("date"),
                        "total_secs", "num_unq"))


def usage_share_of_max(logs: DataFrame) -> DataFrame:
    """Each day's secs as a percent of the customer's maximum (max 0 -> 1).
    The maxima are partial aggregates and joined back by customer, a join that Spark
    can split where one customer holds a large share of the rows."""
    top = logs.groupBy("msno").agg(F.max("total_secs").alias("_max"))
    denom = F.when(F.col("_max") > 0, F.col("_max")).otherwise(F.lit(1.0))
    return (logs.select("msno", "log_date", "total_secs").join(top, "msno", "left")
                .select("msno", "log_date", "total_secs",
                        (F.col("total_secs") / denom * F.lit(100.0)).alias("pct_of_max")))


def simulate(scenarios: DataFrame, base: DataFrame, score: Callable[[DataFrame], DataFrame],
             business: BusinessConfig = BusinessConfig(), thresholds: RiskThresholds = RiskThresholds(),
             serve: ServeConfig = ServeConfig()) -> DataFrame:
    """What-if.  ``scenarios`` = (scenario_id, msno, <override columns>);
    each supplied override replaces the base value (NULL keeps it), every
    other feature stays, and the batch is rescored with ``score`` (a function
    adding ``churn_probability``: a fitted model's transform or a formula).
    Unknown ids drop out (inner join)."""
    overrides = [c for c in SCENARIO_FIELDS if c in scenarios.columns]
    s = scenarios.select("scenario_id", "msno", *[F.col(c).alias(f"_o_{c}") for c in overrides])
    j = s.join(base.drop(*[c for c in PREDICTION_COLUMNS if c in base.columns]), "msno", "inner")
    for c in overrides:
        j = j.withColumn(c, F.coalesce(F.col(f"_o_{c}").cast(base.schema[c].dataType), F.col(c))).drop(f"_o_{c}")
    j = score(j)
    j = j.withColumns({
        "risk_tier": risk_tier("churn_probability", thresholds),
        "estimated_clv": estimated_clv(business),
        "low_confidence": low_confidence("days_since_registration", serve.low_confidence_threshold_days),
    })
    return j.withColumn("expected_value", expected_value("churn_probability", "estimated_clv", business)) \
            .select("scenario_id", "msno", *overrides, *PREDICTION_COLUMNS)
