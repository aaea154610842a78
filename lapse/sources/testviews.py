"""Domain views over the driver's test tables (see FIXTURES.md section 2).

The driver ships TPC-H-like tables; these views turn them into the four
domain tables (members, transactions, user_logs, train) plus a stand-in
score, identically in Spark (functions below) and in SQL (``ORACLE_PREFIX``,
shared by every oracle query).  All views are full-table projections and
aggregates, so their work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.operators.labels import label_churn
from lapse.sources.readers import prepare_transactions

# Fixed values of the test views.
REFERENCE_DATE = "2001-07-28"
LABEL_CUTOFF = "2000-12-31"
LABEL_GAP_DAYS = 270
LOG_DAY_SHIFT = 8218
REGISTRATION_ORIGIN = "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.cast("string").alias("msno"),
        F.col("c_nationkey").cast("int").alias("city"),
        F.floor(F.col("c_acctbal") / F.lit(90)).cast("int").alias("bd"),
        F.when(k % 3 == 0, F.lit("male")).when(k % 3 == 1, F.lit("female")).alias("gender"),
        F.when(k % 149 == 0, F.lit(13)).when(k % 5 == 0, F.lit(9)).when(k % 11 == 0, F.lit(None))
         .otherwise(F.lit(7)).cast("int").alias("registered_via"),
        F.date_add(F.lit(REGISTRATION_ORIGIN).cast("date"), ((k * 911) % 2400).cast("int"))
         .alias("registration_init_time"),
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    plan_days = (F.when(k % 10 == 0, 0).when(k % 10 == 1, 7).when(k % 10 == 2, 90)
                  .when(k % 10 == 3, 410).otherwise(30)).cast("int")
    price = F.when(k % 4 == 0, 99.0).when(k % 4 == 1, 129.0).otherwise(149.0).cast("double")
    tdate = F.to_date(F.col("o_orderdate"))
    return o.select(
        F.col("o_custkey").cast("string").alias("msno"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("payment_method_id"),
        plan_days.alias("payment_plan_days"),
        price.alias("plan_list_price"),
        price.alias("actual_amount_paid"),
        (F.col("o_orderstatus") == "O").cast("int").alias("is_auto_renew"),
        tdate.alias("transaction_date"),
        F.date_add(tdate, plan_days).alias("membership_expire_date"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_cancel"),
        k.alias("seq"),
    )


def transactions(spark: SparkSession, sf_dir: str, reference_date=REFERENCE_DATE) -> DataFrame:
    """Cutoff-filtered (when a date is given) and same-day deduplicated."""
    return prepare_transactions(raw_transactions(spark, sf_dir), reference_date, seq_col="seq")


def user_logs(spark: SparkSession, sf_dir: str, until=None) -> DataFrame:
    """Daily log rows; with ``until`` only the days up to that date, as a filter on the scan."""
    e = table(spark, sf_dir, "events")
    if until is not None:
        kind = e.schema["ts"].dataType
        e = e.filter(F.col("ts") < F.date_add(F.lit(str(until)).cast("date"), LOG_DAY_SHIFT + 1).cast(kind))
    day = F.date_sub(F.to_date(F.col("ts")), LOG_DAY_SHIFT)
    return (e.groupBy(F.col("user_id").cast("string").alias("msno"), day.alias("log_date"))
             .agg(F.count(F.when(F.col("event_type") == "view", 1)).cast("int").alias("num_25"),
                  F.count(F.when(F.col("event_type") == "click", 1)).cast("int").alias("num_100"),
                  # distinct types per user-day, bounded by the handful of event types: a
                  # set in the same aggregate avoids a second shuffle of the event table
                  F.size(F.collect_set("event_type")).cast("int").alias("num_unq"),
                  F.sum("value").alias("total_secs")))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = raw_transactions(spark, sf_dir)
    return label_churn(tx, LABEL_CUTOFF, LABEL_GAP_DAYS, seq_col="seq").select("msno", "is_churn")


def stand_in_probability(msno_col="msno"):
    """Deterministic stand-in score until a model scores the table: nearly unique (a hash
    fraction of the id) and dependent on the four fields that a scenario can override."""
    fraction = F.conv(F.substring(F.md5(F.col(msno_col)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    days = F.greatest(F.col("days_since_registration"), F.lit(0)).cast("double")
    x = (F.lit(0.55) * fraction
         + F.lit(0.15) * (F.lit(1) - F.col("is_auto_renew")).cast("double")
         + F.lit(0.1) * (F.least(F.col("plan_list_price").cast("double"), F.lit(150.0)) / F.lit(150.0))
         + F.lit(0.1) * (F.least(F.col("payment_plan_days"), F.lit(410)).cast("double") / F.lit(410.0))
         + F.lit(0.1) * (days / (days + F.lit(365.0))))
    return x * x


# ---------------------------------------------------------------- SQL mirror

ORACLE_PREFIX = f"""
WITH members AS (
  SELECT CAST(c_custkey AS VARCHAR) AS msno,
         CAST(c_nationkey AS INTEGER) AS city,
         CAST(floor(c_acctbal / 90) AS INTEGER) AS bd,
         CASE WHEN c_custkey % 3 = 0 THEN 'male' WHEN c_custkey % 3 = 1 THEN 'female' END AS gender,
         CAST(CASE WHEN c_custkey % 149 = 0 THEN 13 WHEN c_custkey % 5 = 0 THEN 9
                   WHEN c_custkey % 11 = 0 THEN NULL ELSE 7 END AS INTEGER) AS registered_via,
         CAST(DATE '{REGISTRATION_ORIGIN}' + CAST((c_custkey * 911) % 2400 AS INTEGER) AS DATE) AS registration_init_time
  FROM customer
),
raw_transactions AS (
  SELECT CAST(o_custkey AS VARCHAR) AS msno,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS payment_method_id,
         CAST(CASE o_orderkey % 10 WHEN 0 THEN 0 WHEN 1 THEN 7 WHEN 2 THEN 90 WHEN 3 THEN 410 ELSE 30 END AS INTEGER) AS payment_plan_days,
         CAST(CASE o_orderkey % 4 WHEN 0 THEN 99 WHEN 1 THEN 129 ELSE 149 END AS DOUBLE) AS plan_list_price,
         CAST(CASE o_orderkey % 4 WHEN 0 THEN 99 WHEN 1 THEN 129 ELSE 149 END AS DOUBLE) AS actual_amount_paid,
         CAST(o_orderstatus = 'O' AS INTEGER) AS is_auto_renew,
         CAST(o_orderdate AS DATE) AS transaction_date,
         CAST(CAST(o_orderdate AS DATE) + CAST(CASE o_orderkey % 10 WHEN 0 THEN 0 WHEN 1 THEN 7 WHEN 2 THEN 90 WHEN 3 THEN 410 ELSE 30 END AS INTEGER) AS DATE) AS membership_expire_date,
         CAST(o_orderstatus = 'F' AS INTEGER) AS is_cancel,
         o_orderkey AS seq
  FROM orders
),
dedup_all AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY msno, transaction_date
              ORDER BY is_cancel DESC NULLS FIRST, plan_list_price DESC NULLS FIRST, seq DESC) AS rn
    FROM raw_transactions) WHERE rn = 1
),
transactions AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY msno, transaction_date
              ORDER BY is_cancel DESC NULLS FIRST, plan_list_price DESC NULLS FIRST, seq DESC) AS rn
    FROM raw_transactions WHERE transaction_date <= DATE '{REFERENCE_DATE}') WHERE rn = 1
),
user_logs AS (
  SELECT CAST(user_id AS VARCHAR) AS msno,
         CAST(CAST(ts AS DATE) - INTERVAL {LOG_DAY_SHIFT} DAY AS DATE) AS log_date,
         CAST(count(CASE WHEN event_type = 'view' THEN 1 END) AS INTEGER) AS num_25,
         CAST(count(CASE WHEN event_type = 'click' THEN 1 END) AS INTEGER) AS num_100,
         CAST(count(DISTINCT event_type) AS INTEGER) AS num_unq,
         sum(value) AS total_secs
  FROM events
  GROUP BY 1, 2
),
renewals AS (
  SELECT msno, min(transaction_date) AS next_renewal_date FROM raw_transactions
  WHERE transaction_date > DATE '{LABEL_CUTOFF}' AND is_cancel = 0 GROUP BY msno
),
expiries AS (
  SELECT msno, arg_max(membership_expire_date, transaction_date) AS last_expire_date FROM dedup_all
  WHERE transaction_date <= DATE '{LABEL_CUTOFF}' GROUP BY msno
),
label_parts AS (SELECT * FROM expiries LEFT JOIN renewals USING (msno)),
churn_labels AS (
  SELECT msno, last_expire_date, next_renewal_date,
         CAST(date_diff('day', last_expire_date, next_renewal_date) AS INTEGER) AS renewal_gap_days,
         CAST(CASE WHEN next_renewal_date IS NULL OR last_expire_date IS NULL
                     OR date_diff('day', last_expire_date, next_renewal_date) >= {LABEL_GAP_DAYS}
                   THEN 1 ELSE 0 END AS INTEGER) AS is_churn
  FROM label_parts
),
train AS (SELECT msno, is_churn FROM churn_labels)
"""
