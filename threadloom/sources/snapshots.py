"""Tables that grow together: every change is a new version of all of them, and readers see all tables of one version.

A version is a small file in ``_log`` that names the folders each table is made of. A change writes its rows to new
folders first and then adds the next version's file, which only one writer can: whoever finds it there reads the newer
version and does its work again on that. Nothing is ever overwritten, so old versions stay readable, and what a crashed
writer left is in no version.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Fixed value: the version of the tables' columns.
FORMAT = 2
Tables = dict[str, DataFrame]
Upgrade = Callable[[Tables], Tables]


class Conflict(Exception):
    """Another writer has added the version first."""


class Workspace:
    """A folder of versioned tables on any file system of Spark that renames a file only where no other has its name."""

    def __init__(self, spark: SparkSession, path: str, upgrades: dict[int, Upgrade] | None = None):
        """``upgrades`` make the tables of each older format those of the next."""
        self.spark, self.path, self.upgrades = spark, path.rstrip("/"), upgrades or {}
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, path: str, schemas: dict[str, str], format: int = FORMAT) -> Workspace:
        """A new workspace of empty tables; one that is there already is refused."""
        new = cls(spark, path)
        if new._system.exists(new._path(f"{new.path}/_log")):
            raise FileExistsError(path)
        columns = {name: spark.createDataFrame([], schema).schema.jsonValue() for name, schema in schemas.items()}
        new._commit(0, {"format": format, "tables": {name: {"columns": c, "folders": []} for name, c in columns.items()}})
        return new

    def version(self) -> int:
        """The latest version; a folder without one is no workspace."""
        log = self._path(f"{self.path}/_log")
        names = [f.getPath().getName() for f in self._system.listStatus(log)] if self._system.exists(log) else []
        versions = [int(n[: -len(".json")]) for n in names if n.endswith(".json")]
        if not versions:
            raise FileNotFoundError(f"{self.path} is no workspace")
        return max(versions)

    def _said(self, version: int) -> dict:
        said = json.loads("".join(r[0] for r in self.spark.read.text(self._log(version), wholetext=True).collect()))
        missing = [f for f in range(said["format"], FORMAT) if f not in self.upgrades]
        if said["format"] > FORMAT or missing:
            raise ValueError(f"{self.path} has format {said['format']}, not {FORMAT}")
        return said

    def read(self, version: int | None = None) -> Tables:
        """All tables of one version, the latest if none is named. Those of an older format are read as the present one:
        each format is a view over the one before."""
        said = self._said(self.version() if version is None else version)
        return self._upgraded(said)[1]

    def _upgraded(self, said: dict) -> tuple[Tables, Tables]:
        """The tables as they are stored, and as the present format has them."""
        stored = {name: self._table(t) for name, t in said["tables"].items()}
        tables = stored
        for step in range(said["format"], FORMAT):
            tables = self.upgrades[step](tables)
        return stored, tables

    def migrate(self) -> int:
        """Add a version in the present format, unless the latest is in it; the version that is.

        Tables that the upgrades leave alone keep their folders; the version of the older format stays readable.
        """
        version = self.version()
        said = self._said(version)
        if said["format"] == FORMAT:
            return version
        stored, tables = self._upgraded(said)
        batch, new = uuid.uuid4().hex, {"format": FORMAT, "tables": {}}
        for name, rows in tables.items():
            if rows is stored.get(name):
                new["tables"][name] = said["tables"][name]
            else:
                rows.write.parquet(f"{self.path}/{name}/{batch}")
                new["tables"][name] = {"columns": rows.schema.jsonValue(), "folders": [f"{name}/{batch}"]}
        try:
            self._commit(version + 1, new)
        except Conflict:  # another writer has migrated it
            for name in tables:
                self._system.delete(self._path(f"{self.path}/{name}/{batch}"), True)
            return self.migrate()
        return version + 1

    def _table(self, said: dict) -> DataFrame:
        schema = T.StructType.fromJson(said["columns"])
        folders = [f"{self.path}/{f}" for f in said["folders"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def append(self, change: Callable[[Tables], Tables], tries: int = 20) -> int:
        """Add the rows that ``change`` makes from the tables as they are; the version that has them.

        All tables gain their rows at once or none does. ``change`` runs again, on what has become of the tables, if
        another writer was first, so ids and checks that it takes from the tables hold. A change without rows adds no
        version.
        """
        for _ in range(tries):
            version = self.version()
            said = self._said(version)
            if said["format"] != FORMAT:
                raise ValueError(f"{self.path} has format {said['format']}: migrate it first")
            tables = {name: self._table(t) for name, t in said["tables"].items()}
            batch, grew = uuid.uuid4().hex, False
            for name, rows in change(tables).items():
                folder = f"{name}/{batch}"
                rows.select(*[rows[c].cast(tables[name].schema[c].dataType) for c in tables[name].columns]).write.parquet(f"{self.path}/{folder}")
                if self.spark.read.parquet(f"{self.path}/{folder}").isEmpty():
                    self._system.delete(self._path(f"{self.path}/{folder}"), True)
                else:
                    said["tables"][name]["folders"].append(folder)
                    grew = True
            if not grew:
                return version
            try:
                self._commit(version + 1, said)
                return version + 1
            except Conflict:
                for name in said["tables"]:
                    self._system.delete(self._path(f"{self.path}/{name}/{batch}"), True)
        raise Conflict(f"{self.path}: others were first {tries} times")

    def _log(self, version: int) -> str:
        return f"{self.path}/_log/{version:020d}.json"

    def _commit(self, version: int, said: dict) -> None:
        staged = self._path(f"{self.path}/_log/.{uuid.uuid4().hex}")
        out = self._system.create(staged, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        target = self._path(self._log(version))
        if self._system.getScheme() == "file":
            # a local rename would replace the other's file; a link is made only where there is none
            try:
                os.link(staged.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                raise Conflict(self._log(version)) from None
            finally:
                self._system.delete(staged, False)
        elif self._system.exists(target) or not self._system.rename(staged, target):
            self._system.delete(staged, False)
            raise Conflict(self._log(version))
