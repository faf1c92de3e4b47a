"""The session: getting the package to the executors, and folders that driver and executors share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; they need no copy of their own."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        here = Path(__file__).resolve().parent
        name = str(Path(tempfile.mkdtemp(prefix="threadloom-")) / here.name)
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", here.parent, here.name))
        _sent.add(app)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the session ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


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
        delete_at_end(spark, folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session ends."""
    path = f"{shared_folder(spark)}/threadloom/{label}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table, which survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
