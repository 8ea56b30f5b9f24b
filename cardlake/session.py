"""Spark session defaults and the shared scratch space of a job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE picks the final shuffle width; these only set what one task should aim for.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str, conf: dict[str, str] | None = None, hive: bool = False) -> SparkSession:
    """Session with the job defaults; the master and the memory come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    if hive:
        builder = builder.enableHiveSupport()
    return builder.getOrCreate()


def _shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else one below the session's warehouse; every executor reaches both."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable; a folder set by the cluster is kept."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared_dir(spark))


def qualified(spark: SparkSession, path: str) -> str:
    """The full URI of a path; the catalog would place a relative one below its warehouse."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder on shared storage for intermediate files, deleted when the session's JVM ends."""
    path = f"{_shared_dir(spark)}/cardlake-{label}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The rows, written to a new shared folder and read back.

    Later steps read them from there instead of computing them again, and they outlive lost executors.
    """
    path = scratch_dir(frame.sparkSession, label)
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
