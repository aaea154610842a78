"""Session helpers.

Library code never creates its own session on a cluster; jobs and tests call
:func:`local_session`.  Lineage is cut only with reliable checkpoints in the
shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lapse") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Use the cluster's ``spark.checkpoint.dir``; set ``fallback`` only when the
    session names none (tests).  Returns the directory in use, or None."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    target = conf or fallback
    if target:
        sc.setCheckpointDir(target)
    return target


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.  A purely local session that names none gets a
    temporary one; on a cluster that is an error."""
    found = ensure_checkpoint_dir(spark)
    if not found and spark.sparkContext.master.split("[")[0] == "local":
        found = ensure_checkpoint_dir(spark, fallback=tempfile.mkdtemp(prefix="lapse-"))
    if not found:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found


def materialize(df, eager: bool = True):
    """Cut lineage before an iterative fit: a reliable checkpoint into the shared
    folder (survives executor loss)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)
