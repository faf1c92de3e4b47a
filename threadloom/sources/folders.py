"""Folders of files as a data source: ``spark.read.format("media_folders").load(root)``.

The planner lists folders from the top, until there are enough of them to share out; each task then walks its own. With the
option ``filters`` (and ``spark.sql.python.filterPushdown.enabled``) filters on the size and on how a path begins are applied
where the files are listed, and folders outside of such a beginning aren't entered. ``root`` is a path that is mounted on all machines, or a URI of a file system that pyarrow knows.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

NAME = "media_folders"
#: Folders that the planner looks for, so many for each task that could run.
FOLDERS_A_PARTITION, PARTITIONS = 4, 64
#: Files that leave a task at once.
ROWS = 10_000

_TESTS = {EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y}


class Share(InputPartition):
    """Folders to walk, and files that were listed on the way to them; paths are relative to the root."""

    def __init__(self, folders: list[str], files: list[tuple[str, int]]):
        self.folders, self.files = folders, files


class _Reader(DataSourceReader):
    def __init__(self, root: str, partitions: int):
        self.root, self.wanted = root, partitions
        self.begins, self.sizes = "", []

    def _list(self, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """Folders and files in ``folder``. Links are left out; a folder that can't be read is an error."""
        folders, files = [], []
        inner = f"{folder}/" if folder else ""
        if "://" in self.root:
            system, base = fs.FileSystem.from_uri(self.root)
            for e in system.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{folder}".rstrip("/"))):
                if e.type == fs.FileType.Directory:
                    folders.append(inner + e.base_name)
                elif e.type == fs.FileType.File:
                    files.append((inner + e.base_name, e.size))
        else:
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for e in entries:
                    if e.is_symlink():
                        continue
                    if e.is_dir():
                        folders.append(inner + e.name)
                    elif e.is_file():
                        files.append((inner + e.name, e.stat().st_size))
        # only folders on the way to the beginning, or below it
        folders = [f for f in folders if f"{f}/".startswith(self.begins) or self.begins.startswith(f"{f}/")]
        return folders, [f for f in files if f[0].startswith(self.begins) and all(_TESTS[t](f[1], v) for t, v in self.sizes)]

    def partitions(self) -> list[Share]:
        if "://" not in self.root and not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)
        folders, files = [""], []
        while folders and len(folders) < self.wanted * FOLDERS_A_PARTITION:
            below = []
            for folder in folders:
                more, here = self._list(folder)
                below += more
                files += here
            folders = below
        n = max(1, min(self.wanted, len(folders)))
        return [Share(folders[i::n], files[i::n]) for i in range(n)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        held, folders = partition.files, partition.folders[::-1]
        while folders or held:
            while folders and len(held) < ROWS:
                more, here = self._list(folders.pop())
                folders += more
                held = held + here
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in held], pa.string()), pa.array([f[1] for f in held], pa.int64())], ["relative_path", "size"])
            held = []


class _FilteredReader(_Reader):
    """For sessions that push filters into Python sources; others refuse a reader that could take them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("size",):
                self.sizes.append((type(f), f.value))
            elif isinstance(f, StringStartsWith) and f.attribute == ("relative_path",) and not self.begins:
                self.begins = f.value
            else:
                yield f


class MediaFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "relative_path string, size long"

    def reader(self, schema) -> DataSourceReader:
        kind = _FilteredReader if self.options.get("filters") == "true" else _Reader
        return kind(self.options["path"].rstrip("/") or "/", int(self.options.get("partitions", PARTITIONS)))


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, size) of all files below ``root``, hidden ones included."""
    spark.dataSource.register(MediaFolders)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).option("filters", filters).option("partitions", max(PARTITIONS, spark.sparkContext.defaultParallelism * 4)).load(root)
