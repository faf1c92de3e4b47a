"""Files are hashed once, in the run after their arrival."""

from __future__ import annotations

import hashlib

import pytest

from threadloom.sources import archive
from threadloom.sources.snapshots import Workspace
from threadloom.streaming.hashing import arriving_files, keep_hashes, link_arriving


def test_each_file_is_hashed_once(spark, tmp_path):
    folder, target, checkpoint = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    (folder / "a/b").mkdir(parents=True)
    contents = {"one.jpg": b"one", "a/two.jpg": b"two", "a/b/copy.jpg": b"one"}
    for name, data in contents.items():
        (folder / name).write_bytes(data)

    def run():
        keep_hashes(arriving_files(spark, f"file://{folder}", 2), target, checkpoint)
        return {r["path"].split("/in/")[1]: (r["size"], r["sha256"]) for r in spark.read.parquet(target).collect()}, spark.read.parquet(target).count()

    want = {n: (len(d), hashlib.sha256(d).hexdigest().upper()) for n, d in contents.items()}
    assert run() == (want, 3)
    (folder / "late.jpg").write_bytes(b"late")
    want["late.jpg"] = (4, hashlib.sha256(b"late").hexdigest().upper())
    assert run() == (want, 4) and run() == (want, 4)


def test_arriving_files_are_linked_once(spark, tmp_path):
    """A run that dies after it has committed a batch, and is started again, ends like one that didn't."""
    folder, checkpoint, keep = tmp_path / "in", f"file://{tmp_path}/check", archive.stored(spark, f"file://{tmp_path}/kept")
    contents = {"one.jpg": b"one", "a/two.jpg": b"two", "a/b/copy.jpg": b"one", "short.jpg": b"tw", "z": b"one"}
    for name, data in contents.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)
    w = Workspace.create(spark, f"file://{tmp_path}/w", archive.TABLES)
    found = spark.createDataFrame([(n, len(d), "Other" if n == "z" else "Image") for n, d in contents.items()], "relative_path string, size long, media_type string")
    w.append(lambda t: archive.inventory_source(t, found, f"{folder}", "Other", keep))
    commit, left = w.append, [1]

    def dies(change):
        commit(change)
        if left.pop():
            raise RuntimeError("died")

    w.append = dies
    stream = lambda: arriving_files(spark, f"file://{folder}", 2)
    with pytest.raises(Exception, match="died"):
        link_arriving(stream(), w, 1, f"{folder}", keep, checkpoint)
    w.append = commit
    assert w.version() == 2
    link_arriving(stream(), w, 1, f"{folder}", keep, checkpoint)
    t = w.read()
    ids = {r["file_id"]: r["relative_path"] for r in t["media_file"].collect()}
    assets = {r["asset_id"]: r["sha256"] for r in t["media_asset"].collect()}
    linked = sorted((ids[r["file_id"]], assets[r["asset_id"]]) for r in t["media_asset_file"].collect())
    want = sorted((n, hashlib.sha256(contents[n]).hexdigest().upper()) for n in contents)
    # the first batch settles the type of a content that two types share
    assert len(assets) == 3 and {n for n, _ in want} - {n for n, _ in linked} in ({"z"}, {"one.jpg", "a/b/copy.jpg"}) and set(linked) <= set(want)
    version = w.version()
    link_arriving(stream(), w, 1, f"{folder}", keep, checkpoint)
    assert w.version() == version
