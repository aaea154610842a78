"""Sinks (IO5, IO6, IO9-IO12).

Writes go to paths the caller passes (a shared filesystem or object store on
a cluster).  Every write is a single Spark action; nothing is assembled on the
driver except the one-row metadata records.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.sources import commits


def write_feature_table(df: DataFrame, path: str, reference_date, partitioned: bool = False,
                        sort_within: bool = True) -> None:
    """IO5: Parquet feature table, range-partitioned and sorted by ``msno``, so each
    file covers its own ids and point lookups skip files and row groups by their
    statistics; optionally partitioned by ``reference_date`` when snapshots accumulate
    (writing one again replaces that snapshot and leaves the others)."""
    out = df
    if sort_within:
        out = out.repartitionByRange("msno").sortWithinPartitions("msno")
    if partitioned:
        out = out.withColumn("reference_date", F.lit(str(reference_date)))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("reference_date").parquet(path))
    else:
        out.write.mode("overwrite").parquet(path)


def publish_feature_table(df: DataFrame, path: str, reference_date, meta: dict | None = None, snapshots: bool = False) -> str:
    """IO5 + IO6: the feature table, sorted as above, as one committed step with its metadata record
    in the manifest (see :mod:`lapse.sources.commits`).  With ``snapshots`` the table
    accumulates one snapshot per reference date, and writing one again replaces it alone."""
    out = df.withColumn("reference_date", F.lit(str(reference_date))) if snapshots else df
    out = out.repartitionByRange("msno").sortWithinPartitions("msno")
    return commits.publish(out, path, str(reference_date), meta, replace_all=not snapshots)


def metadata_record(reference_date, pipeline_version: str = "0.1.0", is_synthetic: bool = False) -> dict:
    """IO6 as a record: version, generation time, reference date, synthetic flag."""
    return {"pipeline_version": pipeline_version, "generation_timestamp": _dt.datetime.now(_dt.timezone.utc).isoformat(),
            "reference_date": str(reference_date), "is_synthetic": bool(is_synthetic)}


def write_metadata(spark: SparkSession, path: str, reference_date, pipeline_version: str = "0.1.0",
                   is_synthetic: bool = False) -> DataFrame:
    """IO6: one-row metadata sidecar (version, generation time, reference date,
    synthetic flag) written as JSON."""
    record = metadata_record(reference_date, pipeline_version, is_synthetic)
    meta = spark.range(1).select(*(F.lit(v).alias(k) for k, v in record.items()))
    meta.coalesce(1).write.mode("overwrite").json(path)
    return meta


def write_thresholds(table: DataFrame, path: str) -> None:
    """IO9: the 3-row tier threshold table (M10 output)."""
    table.coalesce(1).write.mode("overwrite").json(path)


def write_curves(curves: dict[str, tuple[DataFrame, str, str, str]], path: str) -> None:
    """IO10: tidy long curve report (curve, j, x, y) in Parquet; per curve its table and
    the names of its index, x and y columns."""
    parts = [df.select(F.lit(name).alias("curve"), F.col(j).cast("long").alias("j"), F.col(x).cast("double").alias("x"),
                       F.col(y).cast("double").alias("y")) for name, (df, j, x, y) in curves.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.write.mode("overwrite").parquet(path)


def write_confusion(confusion: DataFrame, threshold: float, path: str) -> None:
    """IO10: tn, fp, fn, tp (and the rates with them) at the operating threshold, one row of JSON."""
    (confusion.select(F.lit(float(threshold)).alias("threshold"), "*").coalesce(1).write.mode("overwrite").json(path))


def write_model_metadata(spark: SparkSession, path: str, model_version: str, pipeline_version: str, calibration: str,
                         excluded: tuple[str, ...]) -> None:
    """The model's record: versions, training time, calibration, columns it never sees."""
    (spark.range(1).select(
        F.lit(model_version).alias("model_version"), F.lit(_dt.datetime.now(_dt.timezone.utc).isoformat()).alias("training_date"),
        F.lit(pipeline_version).alias("feature_pipeline_version"), F.lit(calibration).alias("calibration_method"),
        F.array(*(F.lit(c) for c in excluded)).alias("features_dropped"))
     .coalesce(1).write.mode("overwrite").json(path))


def save_model(model: PipelineModel, path: str) -> None:
    """IO11: persist a fitted pipeline (MLlib format)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def log_run(spark: SparkSession, path: str, run_name: str, params: dict | None = None,
            metrics: dict | None = None, run_id: str | None = None) -> str:
    """IO12: (run_id, run_name, kind, name, value, ts) rows in a committed run log
    (``commits.read``); a run id that is logged again replaces its rows.  Metrics may be a
    one-row DataFrame (its columns become metrics)."""
    run_id = run_id or uuid.uuid4().hex
    ts = _dt.datetime.now(_dt.timezone.utc).isoformat()
    rows = [(run_id, run_name, "param", str(k), str(v), ts) for k, v in (params or {}).items()]
    if isinstance(metrics, DataFrame):
        cols = metrics.columns
        long = metrics.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"))
                                                 for c in cols])))
        long = long.select(F.lit(run_id).alias("run_id"), F.lit(run_name).alias("run_name"),
                           F.lit("metric").alias("kind"), "name", "value", F.lit(ts).alias("ts"))
    else:
        rows += [(run_id, run_name, "metric", str(k), str(v), ts) for k, v in (metrics or {}).items()]
        long = None
    schema = "run_id string, run_name string, kind string, name string, value string, ts string"
    out = spark.createDataFrame(rows, schema)
    if long is not None:
        out = out.unionByName(long)
    commits.publish(out.coalesce(1), path, run_id, {"run_name": run_name})
    return run_id
