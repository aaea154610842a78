"""Explicit schemas of the raw source files (no schema inference at read)."""

from pyspark.sql import types as T

# Raw CSV layouts: dates arrive as yyyyMMdd integers/strings and are parsed
# with a null-on-failure rule, so they are read as strings here.
MEMBERS_RAW = T.StructType([
    T.StructField("msno", T.StringType()),
    T.StructField("city", T.IntegerType()),
    T.StructField("bd", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("registered_via", T.IntegerType()),
    T.StructField("registration_init_time", T.StringType()),
])

TRANSACTIONS_RAW = T.StructType([
    T.StructField("msno", T.StringType()),
    T.StructField("payment_method_id", T.IntegerType()),
    T.StructField("payment_plan_days", T.IntegerType()),
    T.StructField("plan_list_price", T.DoubleType()),
    T.StructField("actual_amount_paid", T.DoubleType()),
    T.StructField("is_auto_renew", T.IntegerType()),
    T.StructField("transaction_date", T.StringType()),
    T.StructField("membership_expire_date", T.StringType()),
    T.StructField("is_cancel", T.IntegerType()),
])

USER_LOGS_RAW = T.StructType([
    T.StructField("msno", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("num_25", T.IntegerType()),
    T.StructField("num_50", T.IntegerType()),
    T.StructField("num_75", T.IntegerType()),
    T.StructField("num_985", T.IntegerType()),
    T.StructField("num_100", T.IntegerType()),
    T.StructField("num_unq", T.IntegerType()),
    T.StructField("total_secs", T.DoubleType()),
])

LABELS_RAW = T.StructType([
    T.StructField("msno", T.StringType()),
    T.StructField("is_churn", T.IntegerType()),
])
