"""Session settings the jobs are meant to run with, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # page rows are wide and regex work is CPU-bound: smaller splits keep tasks short and memory low
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.sql.parquet.filterPushdown": "true",
    # seen-keys of the streaming jobs stay on disk instead of in the heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def builder(app_name: str = "leadweave") -> SparkSession.Builder:
    made = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        made = made.config(key, value)
    return made


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster: ``spark.checkpoint.dir``, else the checkpoint folder set on the context. None is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def local_scratch(spark: SparkSession) -> SparkSession:
    """For tests and runs on one machine: a folder of their own where none is set. On a cluster the setting stays required."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leadweave-"))
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read, and go on from the written table: each then reads only its columns."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread the rows over as many partitions as the session setting ``spark.leadweave.spread`` says; unset, they stay where they are.

    For inputs of few row groups, which would leave pattern work to few tasks. The setting is the caller's, whatever the size.
    """
    partitions = df.sparkSession.conf.get("spark.leadweave.spread", None)
    return df.repartition(int(partitions)) if partitions else df
