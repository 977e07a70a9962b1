"""Cut lineage where a table is read many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application, inside the one that `spark.checkpoint.dir` names.

    Only in local mode, where one machine is the cluster, a folder is made when the setting is absent.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fieldlab-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder, so that lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, *by: str, options: dict | None = None) -> DataFrame:
    """Write a table into the shared folder and read it, with a folder per value of `by`, so that a filter on it reads its own rows only.

    For loops: a checkpoint keeps the size estimate of its plan, and estimates of joins multiply from turn to turn until planning no
    longer ends; a written table has its real size. `options` go to the writer.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**(options or {})).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by key only when the input has fewer partitions than there are cores, as a scan of one small file has.

    For heavy work per row; a scan that already fills the cluster stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
