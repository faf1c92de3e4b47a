"""Hashing of media files as they arrive: each run takes the files that earlier runs haven't seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.archive import Keep, link_hashes
from threadloom.sources.snapshots import Workspace

_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of (path, size, sha256) of the files below ``folder``; so many files go into one batch.

    Contents are read whole by the tasks that hash them; for files beyond ``spark.sql.sources.binaryFile.maxLength`` use
    ``sources.inventory.hash_files``, which reads a stretch at a time.
    """
    files = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once).load(folder)
    return files.select("path", F.col("length").alias("size"), F.upper(F.sha2("content", 256)).alias("sha256"))


def keep_hashes(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Write what has arrived to ``target``, a folder for each batch, and return once nothing is left.

    A batch that is run again after a failure replaces its own folder, so each file is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def link_arriving(stream: DataFrame, workspace: Workspace, source_id: int, root: str, keep: Keep, checkpoint: str) -> None:
    """Commit what has arrived below ``root`` to the workspace, and return once nothing is left.

    Each batch of (path, sha256) adds a version with its hashes, new contents and links. A batch that is run again finds its
    files hashed and adds nothing, so a run that dies anywhere and is started again ends like one that didn't. Files that
    the inventory of the source doesn't have are left out.
    """

    def commit(batch: DataFrame, number: int) -> None:
        at = F.locate(f"{root.rstrip('/')}/", F.col("path"))
        relative = F.substring(F.col("path"), at + len(root.rstrip("/")) + 1, F.length("path"))
        hashed = batch.withColumn("relative_path", relative)
        workspace.append(lambda tables: link_hashes(tables, tables["media_file"].where(F.col("source_id") == source_id).join(hashed, "relative_path").select("file_id", "sha256"), keep))

    stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
