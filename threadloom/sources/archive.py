"""What is added to an archive's workspace: imported conversations, inventories of media folders, hashes of their files.

Each function gives the rows of one change for ``Workspace.append``. Ids go on where the tables end: new rows are numbered
along an order over all partitions, and the highest id so far is added.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.ordered import number_rows
from threadloom.sources.chats import PLACEHOLDER
from threadloom.sources.snapshots import Tables

#: The tables of an archive.
TABLES = {
    "import_source": "import_source_id long, doc string",
    "conversation": "conversation_id long, import_source_id long, doc string",
    "participant": "participant_id long, conversation_id long, name string",
    "message": "message_id long, conversation_id long, import_source_id long, sequence_number int, message_type string, participant_id long, content string",
    "attachment": "attachment_id long, message_id long, ordinal int, status string",
    "media_source": "source_id long, root string, source_type string",
    "media_file": "file_id long, source_id long, relative_path string, size long, media_type string",
    "file_hash": "file_id long, sha256 string",
    "media_asset": "asset_id long, sha256 string, media_type string, size long",
    "media_asset_file": "asset_id long, file_id long",
}
Keep = Callable[[DataFrame], DataFrame]


def _numbered(rows: DataFrame, order: list, after: DataFrame, column: str, keep: Keep) -> DataFrame:
    """``rows`` with ``column``: numbers along ``order`` that go on from the highest in ``after``."""
    last = after.agg(F.coalesce(F.max(column), F.lit(0)).alias("__last"))
    return number_rows(rows, order, keep, column).crossJoin(F.broadcast(last)).withColumn(column, F.col(column) + F.col("__last")).drop("__last")


def import_conversations(tables: Tables, messages: DataFrame, keep: Keep) -> Tables:
    """Rows for the conversations in ``messages`` (doc, sequence_number, message_type, sender, content), one for each doc.

    Conversations are numbered by doc, their participants by first appearance, their messages by sequence number; a message
    that is exactly the placeholder has an unresolved attachment. A doc that the workspace holds is an error.
    """
    known = messages.select("doc").distinct().join(tables["conversation"].select("doc"), "doc", "left_semi")
    if not known.isEmpty():
        raise ValueError(f"already imported: {known.first()['doc']}")
    docs = keep(_numbered(messages.select(F.col("doc").cast("string").alias("doc")).distinct(), [F.asc("doc")], tables["conversation"], "conversation_id", keep))
    last = tables["import_source"].agg(F.coalesce(F.max("import_source_id"), F.lit(0))).first()[0]
    first = docs.agg(F.min("conversation_id")).first()[0] or 1
    docs = docs.withColumn("import_source_id", F.col("conversation_id") - first + 1 + last)
    said = messages.withColumn("doc", F.col("doc").cast("string")).join(docs, "doc")
    senders = said.where("message_type = 'User'").groupBy("conversation_id", F.col("sender").alias("name")).agg(F.min("sequence_number").alias("first"))
    people = keep(_numbered(senders, [F.asc("conversation_id"), F.asc("first")], tables["participant"], "participant_id", keep))
    who = people.select("conversation_id", F.col("name").alias("sender"), "participant_id")
    numbered = _numbered(said.drop("participant_id").join(who, ["conversation_id", "sender"], "left"), [F.asc("conversation_id"), F.asc("sequence_number")], tables["message"], "message_id", keep)
    numbered = keep(numbered.withColumn("participant_id", F.when(F.col("message_type") == "User", F.col("participant_id"))))
    lost = numbered.where(F.col("content") == PLACEHOLDER).select("message_id")
    attachments = _numbered(lost, [F.asc("message_id")], tables["attachment"], "attachment_id", keep)
    return {
        "import_source": docs, "conversation": docs, "participant": people, "message": numbered,
        "attachment": attachments.withColumns({"ordinal": F.lit(1), "status": F.lit("Unresolved")}),
    }


def inventory_source(tables: Tables, files: DataFrame, root: str, source_type: str, keep: Keep) -> Tables:
    """Rows for one more media source with its ``files`` (relative_path, size, media_type), numbered by path.

    A root that is, holds or lies in that of another source is an error, and so is one without files.
    """
    at = F.concat(F.rtrim(F.lit(root), F.lit("/")), F.lit("/"))
    there = F.concat(F.rtrim("root", F.lit("/")), F.lit("/"))
    if not tables["media_source"].where(F.startswith(at, there) | F.startswith(there, at)).isEmpty():
        raise ValueError(f"{root} overlaps a source of the workspace")
    if files.isEmpty():
        raise ValueError(f"{root} holds no files")
    source = (tables["media_source"].agg(F.max("source_id")).first()[0] or 0) + 1
    numbered = _numbered(files.select("relative_path", "size", "media_type"), [F.asc("relative_path")], tables["media_file"], "file_id", keep)
    return {
        "media_source": files.sparkSession.createDataFrame([(source, root, source_type)], TABLES["media_source"]),
        "media_file": numbered.withColumn("source_id", F.lit(source).cast("long")),
    }


def link_hashes(tables: Tables, hashed: DataFrame, keep: Keep) -> Tables:
    """Rows that ``hashed`` (file_id, sha256) adds: hashes, the assets they are new for, and links of files to assets.

    A file that has a hash keeps it, so a batch that is given again adds nothing. The first file of a content, by source
    and path, settles its asset's size and media type; ``hash_outcomes`` says what becomes of the others.
    """
    judged = keep(hash_outcomes(tables, hashed, keep))
    linked = judged.where("outcome = 'Linked'")
    new = linked.where("is_new and is_first").select("asset_id", "sha256", "media_type", "size")
    return {"file_hash": linked, "media_asset": new, "media_asset_file": linked}


def hash_outcomes(tables: Tables, hashed: DataFrame, keep: Keep) -> DataFrame:
    """(file_id, sha256, size, media_type, asset_id, is_new, is_first, outcome) of ``hashed`` (file_id, sha256).

    Outcomes: ``Linked``; ``AlreadyHashed``; ``SizeDiffers`` and ``MediaTypeConflict`` from the content's asset, which
    stays as it is; ``UnknownFile``. A file twice in a batch counts once, with its least hash. Contents shared by very many
    files are met by a join whose skewed partitions Spark splits.
    """
    asked = hashed.where("file_id is not null and sha256 is not null").groupBy("file_id").agg(F.upper(F.min("sha256")).alias("sha256"))
    files = asked.join(tables["media_file"], "file_id", "left").join(tables["file_hash"].select("file_id", F.lit(True).alias("had")), "file_id", "left")
    files = keep(files.withColumn("fresh", F.col("source_id").isNotNull() & F.col("had").isNull()))
    place = F.struct("source_id", "relative_path", "file_id")
    firsts = files.where("fresh").groupBy("sha256").agg(F.min(place).alias("place"), F.min_by(F.struct("size", "media_type"), place).alias("kind"))
    fresh = firsts.join(tables["media_asset"].select("sha256"), "sha256", "left_anti")
    fresh = _numbered(fresh, [F.asc("place")], tables["media_asset"], "asset_id", keep)
    assets = tables["media_asset"].select("sha256", "asset_id", F.struct("size", "media_type").alias("kind"), F.lit(None).cast("long").alias("first"), F.lit(False).alias("is_new"))
    assets = assets.union(fresh.select("sha256", "asset_id", "kind", F.col("place.file_id").alias("first"), F.lit(True).alias("is_new")))
    met = files.join(assets, "sha256", "left")
    outcome = (
        F.when(F.col("source_id").isNull(), "UnknownFile").when(~F.col("fresh"), "AlreadyHashed").when(~F.col("size").eqNullSafe(F.col("kind.size")), "SizeDiffers")
        .when(~F.col("media_type").eqNullSafe(F.col("kind.media_type")), "MediaTypeConflict").otherwise("Linked")
    )
    return met.select("file_id", "sha256", "size", "media_type", "asset_id", F.coalesce("is_new", F.lit(False)).alias("is_new"), F.coalesce(F.col("first") == F.col("file_id"), F.lit(False)).alias("is_first"), outcome.alias("outcome"))


def pending_files(tables: Tables, source_id: int | None = None) -> DataFrame:
    """Files without a hash, of one source or of all."""
    files = tables["media_file"] if source_id is None else tables["media_file"].where(F.col("source_id") == source_id)
    return files.join(tables["file_hash"].select("file_id"), "file_id", "left_anti")


def with_attachments(tables: Tables) -> Tables:
    """Tables of format 1, which had no attachments, as format 2: one for each message that is exactly the placeholder.

    They have the numbers of their messages, so that a view gives them without a look at all of them.
    """
    lost = tables["message"].where(F.col("content") == PLACEHOLDER)
    filled = lost.select(F.col("message_id").alias("attachment_id"), "message_id", F.lit(1).alias("ordinal"), F.lit("Unresolved").alias("status"))
    return {**tables, "attachment": filled}


#: What makes the tables of each older format those of the next.
UPGRADES = {1: with_attachments}


def stored(spark: SparkSession, folder: str) -> Keep:
    """A ``Keep`` that writes to ``folder``, which driver and executors share."""

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep
