"""The workspace that grows: versions, writers that meet, crashes, and what imports, inventories and hashes add."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from threadloom.sources import archive
from threadloom.sources.snapshots import Conflict, Workspace

MESSAGE = "doc string, sequence_number int, message_type string, sender string, content string"


@pytest.fixture
def space(spark, tmp_path):
    return Workspace.create(spark, f"file://{tmp_path}/w", archive.TABLES), archive.stored(spark, f"file://{tmp_path}/kept")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_versions(spark, tmp_path, space):
    w, _ = space
    assert w.version() == 0 and all(t.count() == 0 for t in w.read().values())
    with pytest.raises(FileExistsError):
        Workspace.create(spark, w.path, archive.TABLES)
    with pytest.raises(FileNotFoundError):
        Workspace(spark, f"file://{tmp_path}/none").version()
    one = spark.createDataFrame([(1, "a", "x")], archive.TABLES["media_source"])
    assert w.append(lambda t: {"media_source": one}) == 1 and w.append(lambda t: {"media_source": one.where("false")}) == 1
    assert w.append(lambda t: {"media_source": one.withColumn("source_id", F.lit(2))}) == 2
    assert [w.read(v)["media_source"].count() for v in range(3)] == [0, 1, 2]


def test_the_loser_works_again_on_the_newer_version(spark, space):
    """Two writers take ids from one version; the second finds the first's rows and goes on from them."""
    w, _ = space
    seen = []

    def add(tables, also=None):
        seen.append(tables["media_source"].count())
        last = tables["media_source"].agg(F.coalesce(F.max("source_id"), F.lit(0))).first()[0]
        if also:
            also.pop()()  # another writer is faster
        return {"media_source": spark.createDataFrame([(last + 1, "r", "t")], archive.TABLES["media_source"])}

    assert w.append(lambda t: add(t, [lambda: w.append(add)] if not seen else None)) == 2
    assert seen == [0, 0, 1] and rows(w.read()["media_source"], "source_id") == [(1,), (2,)]
    with pytest.raises(Conflict):
        w.append(lambda t: add(t, [lambda: w.append(add)]), tries=1)
    assert w.read()["media_source"].count() == 3


def test_a_crash_leaves_the_version(spark, space):
    w, keep = space
    one = spark.createDataFrame([(1, "a", "x")], archive.TABLES["media_source"])
    bad = spark.createDataFrame([(1, 2)], archive.TABLES["media_file"].split(",")[0] + ", source_id long").withColumns({"relative_path": F.raise_error(F.lit("lost")).cast("string"), "size": F.lit(1), "media_type": F.lit("x")})
    with pytest.raises(Exception, match="lost"):
        w.append(lambda t: {"media_source": one, "media_file": bad})
    assert w.version() == 0 and w.read()["media_source"].count() == 0


def test_imports_go_on_from_one_another(spark, space):
    w, keep = space
    said = [(d, i, "System" if i == 2 else "User", None if i == 2 else f"p{(i * i + len(d)) % 3}", "<Media omitted>" if i % 4 == 1 else f"m{i}") for d in ("b", "a", "cc") for i in range(1, 9)]
    m = spark.createDataFrame(said, MESSAGE)
    w.append(lambda t: archive.import_conversations(t, m.where("doc <> 'a'"), keep))
    first = w.read()
    w.append(lambda t: archive.import_conversations(t, m.where("doc = 'a'"), keep))
    t = w.read()
    assert rows(t["conversation"], "conversation_id", "import_source_id", "doc") == [(1, 1, "b"), (2, 2, "cc"), (3, 3, "a")] and first["message"].count() == 16
    order = [r for d in ("b", "cc", "a") for r in said if r[0] == d]
    people = list(dict.fromkeys((r[0], r[3]) for r in order if r[3]))
    assert [r[1:] for r in rows(t["participant"].join(t["conversation"], "conversation_id"), "participant_id", "doc", "name")] == people
    want = [(n + 1, r[1], r[4], people.index((r[0], r[3])) + 1 if r[3] else None) for n, r in enumerate(order)]
    assert rows(t["message"], "message_id", "sequence_number", "content", "participant_id") == want
    lost = [n + 1 for n, r in enumerate(order) if r[4] == "<Media omitted>"]
    assert rows(t["attachment"], "attachment_id", "message_id", "ordinal", "status") == [(k + 1, n, 1, "Unresolved") for k, n in enumerate(lost)]
    with pytest.raises(ValueError, match="already imported"):
        w.append(lambda t: archive.import_conversations(t, m.where("doc = 'a'"), keep))
    assert w.version() == 2 and w.append(lambda t: archive.import_conversations(t, m.where("false"), keep)) == 2


def test_an_older_format(spark, tmp_path):
    """Read as the present one, refused for changes until it is migrated, and migrated once."""
    path, tables = f"file://{tmp_path}/w", {k: v for k, v in archive.TABLES.items() if k != "attachment"}
    old = Workspace.create(spark, path, tables, 1)
    with pytest.raises(ValueError, match="format 1"):
        old.read()
    w, keep = Workspace(spark, path, archive.UPGRADES), archive.stored(spark, f"file://{tmp_path}/kept")
    assert w.read()["attachment"].count() == 0 and w.version() == 0
    messages = spark.createDataFrame([(i, 1, 1, i, "User", 1, "<Media omitted>" if i % 3 == 0 else f"m{i}") for i in range(1, 10)], archive.TABLES["message"])
    said = w._said(0)
    messages.write.parquet(f"{path}/message/old")
    said["tables"]["message"]["folders"] = ["message/old"]
    w._commit(1, said)
    filled = [(3, 3, 1, "Unresolved"), (6, 6, 1, "Unresolved"), (9, 9, 1, "Unresolved")]
    assert rows(w.read()["attachment"], *w.read()["attachment"].columns) == filled
    more = spark.createDataFrame([("new", 1, "User", "p", "<Media omitted>")], MESSAGE)
    with pytest.raises(ValueError, match="migrate"):
        w.append(lambda t: archive.import_conversations(t, more, keep))
    assert w.migrate() == 2 and w.migrate() == 2 and Workspace(spark, path, archive.UPGRADES).migrate() == 2
    new = Workspace(spark, path)  # needs no upgrades any more
    assert rows(new.read()["attachment"], *new.read()["attachment"].columns) == filled and rows(w.read(1)["attachment"], *w.read(1)["attachment"].columns) == filled
    assert new.append(lambda t: archive.import_conversations(t, more, keep)) == 3
    assert rows(new.read()["attachment"], "attachment_id", "message_id") == [(3, 3), (6, 6), (9, 9), (10, 10)] and rows(new.read()["conversation"], "conversation_id") == [(1,)]


def files(spark, n, seed=0):
    draw = random.Random(seed)
    return spark.createDataFrame([(f"f{i:03}", draw.choice([5, 5, 5, 6]), draw.choice(["Image", "Image", "Video"])) for i in range(n)], "relative_path string, size long, media_type string")


def test_inventories(spark, space):
    w, keep = space
    w.append(lambda t: archive.inventory_source(t, files(spark, 30), "/media/a", "Other", keep))
    w.append(lambda t: archive.inventory_source(t, files(spark, 20, 1), "/media/ab", "Other", keep))
    t = w.read()
    assert rows(t["media_file"], "file_id", "source_id", "relative_path") == [(i + 1, 1, f"f{i:03}") for i in range(30)] + [(i + 31, 2, f"f{i:03}") for i in range(20)]
    assert w.read(1)["media_file"].count() == 30
    for root in ("/media/a/", "/media/a/x", "/media", "/"):
        with pytest.raises(ValueError, match="overlaps"):
            w.append(lambda t, root=root: archive.inventory_source(t, files(spark, 3), root, "Other", keep))
    with pytest.raises(ValueError, match="no files"):
        w.append(lambda t: archive.inventory_source(t, files(spark, 3).where("false"), "/other", "Other", keep))


def hashed_plainly(batches, kinds):
    """(hashes, assets, links, outcomes) of lists of (file_id, sha256), a file at a time; files are in order of their ids."""
    hashes, assets, links, outcomes = {}, {}, set(), []
    for batch in batches:
        said = []
        for f, h in sorted(batch):
            if f not in kinds:
                said.append((f, "UnknownFile"))
            elif f in hashes:
                said.append((f, "AlreadyHashed"))
            else:
                a, *kind = assets.setdefault(h, (len(assets) + 1, *kinds[f]))
                outcome = "SizeDiffers" if kind[0] != kinds[f][0] else "MediaTypeConflict" if kind[1] != kinds[f][1] else "Linked"
                if outcome == "Linked":
                    hashes[f] = h
                    links.add((a, f))
                said.append((f, outcome))
        outcomes.append(sorted(said))
    return hashes, assets, links, outcomes


@pytest.mark.parametrize("seed", [1, 2])
def test_hashes_in_batches(spark, space, seed):
    """Batches that overlap and are given again, against a plain version; a crash between them changes nothing."""
    w, keep = space
    w.append(lambda t: archive.inventory_source(t, files(spark, 60, seed), "/m", "Other", keep))
    kinds = {r["file_id"]: (r["size"], r["media_type"]) for r in w.read()["media_file"].collect()}
    draw = random.Random(seed)
    of = {f: draw.choice(["AA", "AA", "BB", f"C{f % 7}"]) for f in range(1, 62)}
    batches = [[(f, of[f]) for f in sorted(draw.sample(range(1, 62), 25))] for _ in range(3)]
    hashes, assets, links, outcomes = hashed_plainly(batches, kinds)
    for k, batch in enumerate(batches):
        df = spark.createDataFrame([(f, h.lower()) for f, h in batch], "file_id long, sha256 string")
        assert rows(archive.hash_outcomes(w.read(), df, keep), "file_id", "outcome") == outcomes[k]
        if k == 1:  # the job dies before it commits
            with pytest.raises(RuntimeError):
                w.append(lambda t: (archive.link_hashes(t, df, keep), (_ for _ in ()).throw(RuntimeError()))[0])
        before = w.version()
        assert w.append(lambda t, df=df: archive.link_hashes(t, df, keep)) == before + 1
        done = w.append(lambda t, df=df: archive.link_hashes(t, df.where("false"), keep))
        assert done == before + 1
    t = w.read()
    assert dict(rows(t["file_hash"], "file_id", "sha256")) == hashes and t["file_hash"].count() == len(hashes)
    assert rows(t["media_asset"], "sha256", "asset_id", "size", "media_type") == sorted((h, *a) for h, a in assets.items())
    assert rows(t["media_asset_file"], "asset_id", "file_id") == sorted(links)
    assert w.append(lambda t: archive.link_hashes(t, spark.createDataFrame([x for x in hashes.items()], "file_id long, sha256 string"), keep)) == w.version()
    assert rows(archive.pending_files(t), "file_id") == sorted((f,) for f in kinds if f not in hashes) and archive.pending_files(t, 9).count() == 0
