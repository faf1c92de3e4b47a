"""Inventories and hashes of real folders, the workspace on disk, and single guards."""

from __future__ import annotations

import datetime
import hashlib
import os

import pytest

from threadloom.functions import names
from threadloom.operators import guards
from threadloom.sources import folders, inventory, workspace
from pyspark.sql import functions as F


@pytest.fixture
def tree(tmp_path):
    files = {"a.txt": b"one", "Sent/IMG-20240105-WA0001.jpg": b"two", "x/SENT/b.MP4": b"two", "x/y/.hidden": b"", "x/sent items/c.xyz": b"q" * 3_000_000, "x/Sent": b"a file"}
    for name, data in files.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    os.symlink(tmp_path / "root/a.txt", tmp_path / "root/link.txt")
    os.symlink(tmp_path / "root/x", tmp_path / "root/linked")
    (tmp_path / "empty").mkdir()
    return tmp_path, files


def test_discover(spark, tree):
    top, files = tree
    rows = {r["relative_path"]: r for r in inventory.discover(spark, f"{top}/root", names.DATED_SOURCE).collect()}
    assert rows.keys() == files.keys()
    assert {n for n, r in rows.items() if r["is_sent"]} == {"Sent/IMG-20240105-WA0001.jpg", "x/SENT/b.MP4"} and all(r["is_sent"] is not None for r in rows.values())
    assert rows["Sent/IMG-20240105-WA0001.jpg"]["file_date"] == datetime.date(2024, 1, 5) and rows["x/SENT/b.MP4"]["media_type"] == "Video"
    assert rows["x/y/.hidden"]["is_hidden"] and rows["x/y/.hidden"]["media_type"] == "Unknown" and rows["x/sent items/c.xyz"]["size"] == 3_000_000
    assert inventory.discover(spark, f"{top}/empty", "Other").count() == 0
    with pytest.raises(NotADirectoryError):
        inventory.discover(spark, f"{top}/none", "Other")


def test_folders_as_a_source(spark, tree):
    """A tree of any shape, shared out in any number of parts; filters are applied where the files are listed."""
    top, files = tree
    for i in range(40):
        path = top / f"root/deep/{i % 7}/{i % 3}/f{i}"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * i)
        files[f"deep/{i % 7}/{i % 3}/f{i}"] = b"x" * i
    want = sorted((n, len(d)) for n, d in files.items())
    spark.dataSource.register(folders.MediaFolders)
    for parts in (1, 3, 64):
        rows = spark.read.format(folders.NAME).option("partitions", parts).load(f"{top}/root")
        assert sorted(tuple(r) for r in rows.collect()) == want and rows.rdd.getNumPartitions() <= parts
    assert sorted(tuple(r) for r in folders.listed(spark, f"file://{top}/root").collect() if "link" not in r[0]) == [w for w in want if "link" not in w[0]]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        rows = folders.listed(spark, f"{top}/root")
        test = "relative_path like 'deep/3/%' and size > 5 and size <= 31 and relative_path not like '%f17'"
        assert sorted(tuple(r) for r in rows.where(test).collect()) == [(n, k) for n, k in want if n.startswith("deep/3/") and 5 < k <= 31 and not n.endswith("f17")]
        assert rows.where("size = 3000000").count() == 1 and rows.where("relative_path like 'nowhere%'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = folders._FilteredReader(f"{top}/root", 8)
    seen, plain = [], reader._list
    reader._list = lambda f: (seen.append(f), plain(f))[1]
    assert list(reader.pushFilters([folders.StringStartsWith(("relative_path",), "deep/3/")])) == []
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == sum(n.startswith("deep/3/") for n in files) and all(f in ("", "deep", "deep/3") or f.startswith("deep/3/") for f in seen)


def test_hash_files(spark, tree):
    top, files = tree
    found = inventory.discover(spark, f"{top}/root", "Other").select("relative_path", "size")
    more = spark.createDataFrame([("../empty/../root/../secret", 1), ("gone.txt", 2), ("a.txt", 99)], found.schema)
    rows = inventory.hash_files(found.union(more), f"{top}/root").collect()
    assert {r["relative_path"]: r["sha256"] for r in rows if not r["failure"]} == {n: hashlib.sha256(d).hexdigest().upper() for n, d in files.items()}
    assert sorted((r["relative_path"], r["failure"]) for r in rows if r["failure"]) == [("../empty/../root/../secret", "OutsideRoot"), ("a.txt", "SizeChanged"), ("gone.txt", "FileNotFoundError")]


def test_workspace(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    tables = {"message": spark.range(3), "empty": spark.range(0)}
    workspace.write_workspace(tables, path)
    back = workspace.read_workspace(spark, path)
    assert {k: t.count() for k, t in back.items()} == {"message": 3, "empty": 0}
    with pytest.raises(FileExistsError):
        workspace.write_workspace(tables, path)
    with pytest.raises(FileNotFoundError):
        workspace.read_workspace(spark, f"file://{tmp_path}/none")
    old = workspace.VERSION
    workspace.VERSION = 3
    try:
        with pytest.raises(ValueError, match="version 2"):
            workspace.read_workspace(spark, path)
    finally:
        workspace.VERSION = old


def test_marker_names(spark):
    rows = {
        "IMG-20260724-WA0004.jpg": ("2026-07-24", "0004"), "IMG-20261332-WA0004.jpg": (None, None), "IMG-20230229-WA0004.jpg": (None, None), "IMG-20240229-WA0004.jpg": ("2024-02-29", "0004"), "IMG-00000000-WA0004.jpg": (None, None),
        "IMG-00000101-WA0004.jpg": (None, None), "IMG-19000229-WA1.jpg": (None, None), "IMG-20000229-WA1.JPG": ("2000-02-29", "1"), "20260724-WA0004.jpg": (None, None), "IMG-20260724-WA0004 (1).jpg": ("2026-07-24", "0004 (1)"),
        "IMG-20260724-WAabc.jpg": ("2026-07-24", "abc"), "IMG-20260724-XY0004.jpg": (None, None), "x-20261332-WA-20260724-WA7.jpg": ("2026-07-24", "7"), "a-20260724-WA": ("2026-07-24", ""), "a-20260724-WA\nb.jpg": ("2026-07-24", "\nb"),
        "a-20260724-WA1-20250101-WA2.jpg": ("2026-07-24", "1-20250101-WA2"), "a-20260724-WAjpg": ("2026-07-24", "jpg"), "a-00010101-WA0": ("0001-01-01", "0"), "a-20260431-WA0": (None, None),
    }
    df = spark.createDataFrame([(n,) for n in rows], "name string")
    ext = names.extension(F.col("name"))
    got = {r["name"]: (r["d"], r["s"]) for r in df.select("name", names.marker_date(F.col("name")).cast("string").alias("d"), names.suffix(F.col("name"), ext).alias("s")).collect()}
    assert got == rows
    bad = {r["name"] for r in df.where(names.has_marker_shape(F.col("name"), invalid_only=True)).collect()}
    assert bad == {"IMG-20261332-WA0004.jpg", "IMG-20230229-WA0004.jpg", "IMG-00000000-WA0004.jpg", "IMG-00000101-WA0004.jpg", "IMG-19000229-WA1.jpg", "x-20261332-WA-20260724-WA7.jpg", "a-20260431-WA0"}


def test_shape_signatures(spark):
    df = spark.createDataFrame([("0004++ab (1)",), ("",), ("äb-_.[]",), ("\U0001f600x",)], "s string")
    assert [r[0] for r in df.select(names.shape_signature(F.col("s"))).collect()] == ["D4X2A2 (D1)", "", "X1A1-_.[]", "X2A1"]


def test_require(spark):
    good = guards.repeated(spark.range(5), ["id"], "repeated")
    guards.require(good)
    with pytest.raises(ValueError, match="repeated"):
        guards.require(guards.repeated(spark.range(5).union(spark.range(2)), ["id"], "repeated"))
