"""Lineage cuts and scratch files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A session in one process that names none (tests) gets a temporary one; on a cluster that would be another folder on
    each machine, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
        _delete_at_end(spark, folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete_at_end(spark: SparkSession, path: str) -> None:
    target, system = _path(spark, path)
    system.deleteOnExit(target)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session ends."""
    path = f"{shared_folder(spark)}/threadloom/{label}-{uuid.uuid4().hex}"
    _delete_at_end(spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path early."""
    target, system = _path(spark, path)
    system.delete(target, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    The table survives lost executors, and each later use reads it rather than computing ``df`` again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and nothing will read again."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            drop_path(table.sparkSession, folder)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished queries now, rather than when the driver next collects its garbage."""
    spark.sparkContext._jvm.System.gc()
