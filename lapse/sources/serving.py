"""The scored table laid out for lookups by id.

Rows are bucketed and sorted by ``msno``, with a Parquet bloom filter per row group: a batch of
ids is dealt to the buckets and joined without moving the scored side, and a point lookup
opens the row groups whose statistics and bloom filter let the id pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000


def write_serving_table(df: DataFrame, name: str, path: str, buckets: int | None = None, key: str = "msno") -> DataFrame:
    """Write ``df`` to ``path`` as the bucketed table ``name`` and return it.  By default a bucket
    holds about ``ROWS_PER_BUCKET`` rows (one count of the table)."""
    rows = df.count() if buckets is None else None
    buckets = buckets or max(1, -(-rows // ROWS_PER_BUCKET))
    per_file = max(1, (rows or ROWS_PER_BUCKET * buckets) // buckets)
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
     .option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(per_file))
     .bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    return df.sparkSession.table(name)


def open_serving_table(spark: SparkSession, name: str, path: str, buckets: int, schema: str, key: str = "msno") -> DataFrame:
    """Make a table written earlier known to this session's catalogue."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet "
              f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def point_lookup(table: DataFrame, value: str, key: str = "msno") -> DataFrame:
    """The rows of one id: an equality that prunes buckets, row groups and pages."""
    return table.filter(F.col(key) == F.lit(value))
