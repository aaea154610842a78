"""Data-quality and exploratory profiles.

Each profile is a single aggregate pass (partial per task, tiny final) or a
join of small aggregates; wide per-column results are unpivoted to long
``(column, ...)`` rows instead of being collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapse.operators.evaluate import grouped_percentiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def null_percent(df: DataFrame) -> DataFrame:
    """Percent of NULLs per column, one row per column."""
    cols = df.columns
    wide = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "null_pct")


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first for each key combination (one aggregate, then
    a one-row sum)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
              .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))


def date_range(df: DataFrame, cols: list[str]) -> DataFrame:
    """Min and max of date columns, one row per column."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__min").alias("min_date"),
                              F.col(f"{c}__max").alias("max_date")) for c in cols])
    return wide.select(F.inline(rows))


def monthly_counts(df: DataFrame, date_col: str) -> DataFrame:
    """Rows per calendar month between the first and last month, empty
    months as 0, NULL dates dropped.  The month calendar is generated from a
    one-row min/max aggregate; it is bounded by the time span, not the data."""
    d = F.col(date_col)
    month = F.trunc(d, "month")
    counts = df.filter(d.isNotNull()).groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"))
    span = df.agg(F.min(month).alias("lo"), F.max(month).alias("hi"))
    calendar = span.filter(F.col("lo").isNotNull()).select(
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return (calendar.join(counts, "month", "left")
              .select("month", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


MASK_BITS = 62


def memberships(tables: dict[str, DataFrame], key: str = "msno") -> DataFrame:
    """Per distinct id a bit mask of the tables that hold it, ``in_0``, ``in_1``, ... with
    ``MASK_BITS`` tables each.  Every table is read once, as one side of a tagged union, and
    repeated ids (a hot key) collapse map-side; a null id is in no table."""
    words = -(-len(tables) // MASK_BITS)
    union = None
    for i, df in enumerate(tables.values()):
        bits = [F.lit(1 << i % MASK_BITS if w == i // MASK_BITS else 0).cast("long").alias(f"in_{w}") for w in range(words)]
        part = df.select(F.col(key).alias("id"), *bits).where("id is not null")
        union = part if union is None else union.unionByName(part)
    return union.groupBy("id").agg(*(F.bit_or(f"in_{w}").alias(f"in_{w}") for w in range(words)))


def member_of(tables: dict[str, DataFrame], name: str) -> Column:
    """Whether a row of :func:`memberships` is in the named table."""
    i = list(tables).index(name)
    return F.col(f"in_{i // MASK_BITS}").bitwiseAND(F.lit(1 << i % MASK_BITS).cast("long")) != 0


def set_overlaps(tables: dict[str, DataFrame], key: str = "msno") -> DataFrame:
    """(tables, n): how many ids are in exactly these tables ('a+b'), for every combination that
    occurs; all intersections, unions and differences are sums of these rows."""
    names = F.array_compact(F.array(*(F.when(member_of(tables, n), F.lit(n)) for n in tables)))
    return memberships(tables, key).groupBy(F.array_join(names, "+").alias("tables")).agg(F.count(F.lit(1)).alias("n"))


def key_coverage(ids: DataFrame, others: dict[str, DataFrame], key: str = "msno") -> DataFrame:
    """A20 (S2, S4): percent of the distinct ids found in each other table, from one aggregate."""
    tables = {"": ids} | others
    asked = F.when(member_of(tables, ""), F.lit(1))
    wide = memberships(tables, key).agg(F.count(asked).alias("_n"), *(
        F.count(F.when(member_of(tables, n), asked)).alias(f"_{i}") for i, n in enumerate(others)))
    rows = F.array(*(F.struct(F.lit(n).alias("table"), F.col(f"_{i}").alias("found"),
                              (F.try_divide(F.col(f"_{i}"), F.col("_n")) * 100).alias("coverage_pct")) for i, n in enumerate(others)))
    return wide.select(F.inline(rows))


def distinct_ids(df: DataFrame, key: str = "msno") -> DataFrame:
    """A25 / S4."""
    return df.select(key).distinct()


def listening_by_label(logs: DataFrame, labels: DataFrame, key: str = "msno") -> DataFrame:
    """A22 (J8): average daily seconds by churn label over the log rows of
    labelled customers.  Logs are first reduced to one (sum, count) row per
    customer (partial aggregation before the shuffle), so a customer holding
    a third of the log rows costs one row per map task; the join is then
    between per-customer tables."""
    per = logs.groupBy(key).agg(F.sum("total_secs").alias("_s"), F.count("total_secs").alias("_n"))
    return (per.join(labels.select(key, "is_churn"), key, "inner")
               .groupBy("is_churn").agg((F.sum("_s") / F.sum("_n")).alias("avg_secs")))


def churn_rate_by(labels: DataFrame, members: DataFrame, col: str = "city", key: str = "msno") -> DataFrame:
    """A23 (J7): mean label per segment value (customers absent from members in
    the NULL segment)."""
    return (labels.join(members.select(key, col), key, "left")
                  .groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_churn").cast("double")).alias("churn_rate")))


def column_types(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, position, type, n_null) of several tables; one aggregate each."""
    parts = []
    for name, df in tables.items():
        counts = df.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(f"__{i}") for i, c in enumerate(df.columns)))
        rows = [F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(i).alias("position"),
                         F.lit(kind).alias("type"), F.coalesce(F.col(f"__{i}"), F.lit(0)).alias("n_null"))
                for i, (c, kind) in enumerate(df.dtypes)]
        parts.append(counts.select(F.inline(F.array(*rows))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_profile(df: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count / mean / std / min / quartiles / max of every numeric column
    as long rows (column, stat, value), plus the row count.  One aggregate for
    the moments; quartiles are exact (linear interpolation) for all columns in
    one long-form pass grouped by column."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in num:
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit("*").alias("column"), F.lit("rows").alias("stat"),
                     F.col("__rows").cast("double").alias("value"))]
    for c in num:
        for s in ("count", "mean", "std", "min", "max"):
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(s).alias("stat"), F.col(f"{c}__{s}").alias("value")))
    out = wide.select(F.inline(F.array(*rows)))
    if not num:
        return out
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                        for c in num])))
    pc = grouped_percentiles(long, ["column"], "value", list(quantiles))
    names = [c for c in pc.columns if c != "column"]
    q_rows = F.array(*[F.struct(F.lit(f"{int(q * 100)}%").alias("stat"), F.col(n).alias("value"))
                       for q, n in zip(quantiles, names)])
    return out.unionByName(pc.select("column", F.inline(q_rows)))
