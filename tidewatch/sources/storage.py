"""Shared storage: reliable checkpoints and written intermediate tables.

Both live under ``spark.checkpoint.dir``, the folder every executor can reach. Only in a local session
(tests), where driver and executors are one process, may a temporary folder stand in for it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
    fallback = tempfile.mkdtemp(prefix="tidewatch-")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def materialise(df: DataFrame) -> DataFrame:
    """Write once to shared storage and cut the lineage: later passes read files, and an
    executor lost meanwhile costs a re-read, not a recomputation that could order rows anew."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """As ``materialise``, but columnar: for tables that several later passes read some columns of."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(stored: DataFrame) -> DataFrame:
    """For passes that cost time rather than bytes: a stored table of fewer partitions than there are
    cores is dealt out evenly. Tables large enough to occupy the cluster pass through unchanged."""
    lanes = stored.sparkSession.sparkContext.defaultParallelism
    return stored.repartition(lanes) if stored.rdd.getNumPartitions() < lanes else stored


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables of ours that nothing reads any more, wherever the file system is."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table; never reused, never cleared by us."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
