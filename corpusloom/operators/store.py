"""Intermediate tables in the shared folder, for results that several steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_ready(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster (spark.checkpoint.dir). In local mode, where none is set, one of our own; on a
    cluster that is an error, as a machine's own folder is not shared."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder once and read from there by all that follows; lost executors cost a retry only."""
    spark = df.sparkSession
    path = f"{checkpoint_ready(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)  # goes with the application
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in as many parts as there are cores at least: a file of few row groups is not one task's work. Inputs of more
    parts, as on a cluster, are passed on as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
