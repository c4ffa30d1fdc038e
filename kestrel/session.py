"""Session construction and lineage control.

On a cluster the session comes from the platform with ``spark.checkpoint.dir``
pointing at shared storage; we only read it.  Local runs and tests set their
own directory when (and only when) none is configured.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "kestrel",
                shuffle_partitions: int | None = None,
                extra: dict | None = None, driver_memory: str | None = None) -> SparkSession:
    """Return the active session, or build one with AQE and UTC time.

    ``driver_memory`` only matters for local mode (the driver JVM is the
    executor); on a cluster the platform sizes executors.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Make sure a checkpoint directory is set and return it.

    The cluster's ``spark.checkpoint.dir`` wins.  Only in local mode, where one
    machine is all there is, is a temp folder made when nothing is set; a cluster
    without the setting is an error, since its machines would not see each other's files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if fallback is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    path = fallback or tempfile.mkdtemp(prefix="kestrel-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoint dir (shared storage on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (tokenising, vector scoring) enough tasks.

    Only when the input is read from fewer files than the cluster's default
    parallelism is it round-robin repartitioned; a large input already split into
    many files is left untouched, so no shuffle of the raw data is added at scale.
    The file list is known to the driver: no job runs.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < target:
        return df.repartition(target)
    return df


def cut_lineage(df: DataFrame, how: str = "parquet") -> DataFrame:
    """Cut lineage by materialising ``df`` in the shared checkpoint folder.

    ``how='parquet'`` (default) writes a Parquet table and reads it back: one
    computation, survives executor loss, and later stages prune columns and
    push filters into it.  ``how='checkpoint'`` uses a reliable RDD
    checkpoint (never a local one).
    """
    spark = df.sparkSession
    if how == "parquet":
        path = shared_dir(spark, "table")
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)
