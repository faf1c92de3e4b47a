"""Inventories of media folders: what files there are, what their names and places say, and the hashes of their contents."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.names import extension, file_date, media_type, under_sent
from threadloom.sources.folders import listed

#: Bytes of a file that are read at once.
READ_BYTES = 1 << 20

def discover(spark: SparkSession, root: str, source_type: str) -> DataFrame:
    """(relative_path, name, ext, size, media_type, is_hidden, file_date, under_sent, is_sent) of all files below ``root``.

    Folders are listed by the tasks that walk them (``sources.folders``). Hidden files count; links don't. Direction is known in
    a source that has a folder ``Sent`` anywhere. A root that is no folder is an error.
    """
    if "://" not in root and not os.path.isdir(root):
        raise NotADirectoryError(root)
    files = listed(spark, root).withColumn("relative_path", F.replace("relative_path", F.lit("\\"), F.lit("/")))
    rows = files.withColumn("name", F.element_at(F.split("relative_path", "/"), -1))
    rows = rows.withColumns({"ext": extension(F.col("name")), "under_sent": under_sent(F.col("relative_path"))})
    rows = rows.withColumns({"media_type": media_type(F.col("ext"), F.col("size")), "is_hidden": F.startswith("name", F.lit(".")), "file_date": file_date(F.lit(source_type), F.col("name"))})
    known = rows.agg(F.coalesce(F.bool_or("under_sent"), F.lit(False)).alias("known"))
    rows = rows.crossJoin(known)  # one row
    return rows.select("relative_path", "name", "ext", "size", "media_type", "is_hidden", "file_date", "under_sent", F.when(F.col("known"), F.col("under_sent")).alias("is_sent"))


def with_direction(files: DataFrame) -> DataFrame:
    """Append ``is_sent`` to files (source_id, path): null in sources without any folder ``Sent``."""
    f = files.withColumn("under_sent", under_sent(F.col("path")))
    known = f.groupBy("source_id").agg(F.bool_or("under_sent").alias("known"))
    return f.join(F.broadcast(known), "source_id").withColumn("is_sent", F.when(F.col("known"), F.col("under_sent"))).drop("known", "under_sent")  # a row for each source


def hash_files(files: DataFrame, root: str) -> DataFrame:
    """(relative_path, sha256, bytes_read, failure): the SHA-256 of each file's content in capital hex.

    Files are read a stretch at a time by the tasks that hold their rows. A path that leads out of ``root``, a file that can't
    be read, and one whose size isn't the recorded one have a failure and no hash.
    """
    base = os.path.realpath(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rel, size in zip(batch["relative_path"].to_pylist(), batch["size"].to_pylist(), strict=True):
                path, digest, n, failure = os.path.realpath(os.path.join(base, rel)), hashlib.sha256(), 0, None
                if not path.startswith(base + os.sep):
                    failure = "OutsideRoot"
                else:
                    try:
                        with open(path, "rb") as f:
                            while part := f.read(READ_BYTES):
                                digest.update(part)
                                n += len(part)
                        failure = None if n == size else "SizeChanged"
                    except OSError as error:
                        failure = type(error).__name__
                out.append((rel, None if failure else digest.hexdigest().upper(), n, failure))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], ["relative_path", "sha256", "bytes_read", "failure"])

    return files.select("relative_path", "size").mapInArrow(run, "relative_path string, sha256 string, bytes_read long, failure string")
