"""Scans of the raw source tables (IO1-IO4, IO7, IO8).

CSV sources are read with explicit schemas (no inference pass over the data);
dates are parsed with a null-on-failure rule.  Every reader is lazy: the
cutoff filter of a fact table is a plain ``filter`` so Catalyst pushes it into
the scan (Parquet row-group skipping) when the source is columnar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapse.functions.dates import date_lit, parse_yyyymmdd
from lapse.operators.dedup import dedup_same_day
from lapse.sources import commits, schemas


def read_named_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Columns are bound by the header's names, in any order; further ones are left out
    and a missing one is an error.  Only the header line is read for that."""
    header = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in schema.names if c not in header]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in schema.fields}
    wide = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    return (spark.read.schema(wide).option("header", True).option("enforceSchema", False)
            .option("mode", "PERMISSIVE").csv(path).select(*schema.names))


def parse_members(raw: DataFrame) -> DataFrame:
    """IO1 on text columns: the registration date parsed (bad -> NULL)."""
    return raw.withColumn("registration_init_time", parse_yyyymmdd("registration_init_time"))


def parse_transactions(raw: DataFrame) -> DataFrame:
    """IO2 on text columns: both dates parsed (bad -> NULL)."""
    return raw.withColumns({c: parse_yyyymmdd(c) for c in ("transaction_date", "membership_expire_date")})


def parse_user_logs(raw: DataFrame) -> DataFrame:
    """IO3 on text columns: ``date`` as ``log_date``."""
    return raw.withColumn("log_date", parse_yyyymmdd("date")).drop("date")


def load_members(spark: SparkSession, path: str) -> DataFrame:
    """IO1: members."""
    return parse_members(read_named_csv(spark, path, schemas.MEMBERS_RAW))


def prepare_transactions(df: DataFrame, reference_date=None, seq_col: str | None = None) -> DataFrame:
    """IO2 on an already-typed table: cutoff (P1) then same-day dedup.

    With a reference date, rows dated after it or without a date drop out;
    without one, all rows stay.
    """
    if reference_date is not None:
        df = df.filter(F.col("transaction_date") <= date_lit(reference_date))
    return dedup_same_day(df, seq_col=seq_col)


def load_transactions(spark: SparkSession, path: str, reference_date=None) -> DataFrame:
    """IO2: transactions, 2 dates parsed, cutoff-filtered, deduplicated per day."""
    return prepare_transactions(parse_transactions(read_named_csv(spark, path, schemas.TRANSACTIONS_RAW)), reference_date)


def load_user_logs(spark: SparkSession, path: str) -> DataFrame:
    """IO3 scan part: daily listening rows with ``log_date`` as DATE.

    The per-customer aggregate is :func:`lapse.operators.logs.aggregate_logs`,
    which requires an explicit reference date (no 'today' default).
    """
    return parse_user_logs(read_named_csv(spark, path, schemas.USER_LOGS_RAW))


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    return read_named_csv(spark, path, schemas.LABELS_RAW)


def base_cohort(labels: DataFrame | None = None, spark: SparkSession | None = None,
                msno_list: list[str] | None = None) -> DataFrame:
    """IO4: distinct ``msno`` of the labels, or exactly the caller's list.

    A caller-supplied list is kept as given (duplicates included); it is a
    request-sized list, validated by its caller.
    """
    if msno_list is not None:
        if spark is None:
            raise ValueError("spark is required with msno_list")
        return spark.createDataFrame([(m,) for m in msno_list], "msno string")
    return labels.select("msno").dropDuplicates(["msno"])


def read_feature_table(spark: SparkSession, path: str, columns: list[str] | None = None, reference_date=None) -> DataFrame:
    """IO7: the feature table, committed (``writers.publish_feature_table``) or plain Parquet;
    selecting columns prunes the scan, ``reference_date`` opens that snapshot alone."""
    if commits.is_committed(spark, path):
        df = commits.read(spark, path, [str(reference_date)] if reference_date is not None else None)
    else:
        df = spark.read.parquet(path)
        if reference_date is not None and "reference_date" in df.columns:
            df = df.filter(F.col("reference_date") == str(reference_date))
    return df.select(*columns) if columns else df


def sample_rows(df: DataFrame, n: int = 5000) -> DataFrame:
    """IO8: some ``n`` rows of a scan for a look at the data; which ones is not defined,
    so no query is registered on it (``profile.table_profile`` covers the whole table)."""
    return df.limit(n)
