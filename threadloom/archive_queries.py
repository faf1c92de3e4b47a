"""Registered queries over a workspace that grows: imports, inventories and hashes added in several versions, and exports read by ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.plans.views import chat_exports, media_files, oracle
from threadloom.session import scratch_path
from threadloom.sources import archive
from threadloom.sources.chats import parse_lines, parse_messages, scan_exports
from threadloom.sources.snapshots import Workspace

Query = Callable[[SparkSession, str], DataFrame]


def _new(spark: SparkSession) -> tuple[Workspace, archive.Keep]:
    return Workspace.create(spark, scratch_path(spark, "workspace"), archive.TABLES), archive.stored(spark, scratch_path(spark, "kept"))


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of the archive with a path, and for most of them the hash of a content that several share."""
    files = media_files(spark, sf_dir)
    content = F.concat(F.lit("ab"), (F.col("asset_id") % 5000).cast("string"))
    return files.select("file_id", "source_id", F.concat("name", F.lit("/"), F.col("file_id").cast("string")).alias("relative_path"), "size", "media_type", F.when(F.col("file_id") % 9 != 0, content).alias("sha256"))


def linked_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of all files, hashed in three batches: two sources, then all of them again with the rest, then all once more."""
    workspace, keep = _new(spark)
    files = keep(_inventory(spark, sf_dir))
    workspace.append(lambda tables: {"media_file": files})
    for batch in (files.where("source_id <= 2"), files, files):
        workspace.append(lambda tables, batch=batch: archive.link_hashes(tables, batch.select("file_id", "sha256"), keep))
    now = workspace.read()
    return now["media_asset_file"].join(now["media_asset"], "asset_id").join(now["file_hash"].withColumnRenamed("sha256", "hash"), "file_id").select("file_id", "asset_id", "hash", "sha256", "size", "media_type")


LINKED_SQL = """,
inventory AS (SELECT file_id, source_id, name || '/' || file_id AS relative_path, size, media_type, CASE WHEN file_id % 9 <> 0 THEN 'AB' || (asset_id % 5000) END AS sha256 FROM files),
hashed AS (SELECT *, CASE WHEN source_id <= 2 THEN 1 ELSE 2 END AS batch FROM inventory WHERE sha256 IS NOT NULL),
firsts AS (SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY batch, source_id, relative_path, file_id) = 1),
assets AS (SELECT row_number() OVER (ORDER BY batch, source_id, relative_path, file_id) AS asset_id, sha256, size, media_type FROM firsts)
SELECT file_id, asset_id, sha256 AS hash, sha256, size, media_type FROM hashed JOIN assets USING (sha256, size, media_type)"""


def imported_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of all conversations, imported in two parts; ids go on from one part to the next."""
    workspace, keep = _new(spark)
    messages = keep(parse_messages(chat_exports(spark, sf_dir)).select("doc", "sequence_number", "message_type", "sender", "content"))
    for part in (messages.where("doc % 2 = 1"), messages.where("doc % 2 = 0")):
        workspace.append(lambda tables, part=part: archive.import_conversations(tables, part, keep))
    now = workspace.read()
    lost = now["attachment"].select("message_id", "attachment_id")
    out = now["message"].join(now["participant"].select("participant_id", "name"), "participant_id", "left").join(lost, "message_id", "left")
    return out.join(now["conversation"].select("conversation_id", "doc"), "conversation_id").select("message_id", "conversation_id", "import_source_id", "doc", "sequence_number", "participant_id", "name", "content", "attachment_id")


IMPORTED_SQL = """
WITH said AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS sequence_number, role AS name,
                CASE WHEN (conv_id + turn) % 7 = 0 THEN '<Media omitted>' ELSE text END AS content
              FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL),
docs AS (SELECT doc, row_number() OVER (ORDER BY doc % 2 = 0, doc::VARCHAR) AS conversation_id FROM (SELECT DISTINCT doc FROM said)),
firsts AS (SELECT conversation_id, name, min(sequence_number) AS first FROM said JOIN docs USING (doc) GROUP BY ALL),
people AS (SELECT conversation_id, name, row_number() OVER (ORDER BY conversation_id, first) AS participant_id FROM firsts),
numbered AS (SELECT *, row_number() OVER (ORDER BY conversation_id, sequence_number) AS message_id FROM said JOIN docs USING (doc) JOIN people USING (conversation_id, name)),
lost AS (SELECT message_id, row_number() OVER (ORDER BY message_id) AS attachment_id FROM numbered WHERE content = '<Media omitted>')
SELECT message_id, conversation_id, conversation_id AS import_source_id, doc::VARCHAR AS doc, sequence_number, participant_id, name, content, attachment_id FROM numbered LEFT JOIN lost USING (message_id)"""


def inventories_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each source in each version of a workspace to which the four sources are added one by one."""
    workspace, keep = _new(spark)
    files = keep(_inventory(spark, sf_dir).withColumnRenamed("source_id", "of"))
    for source in (1, 2, 3, 4):
        rows = files.where(F.col("of") == source)
        workspace.append(lambda tables, rows=rows, source=source: archive.inventory_source(tables, rows, f"/media/{source}", "WhatsAppMediaDirectory", keep))
    every = None
    for version in range(1, workspace.version() + 1):
        now = workspace.read(version)
        counts = now["media_file"].groupBy("source_id").agg(F.count("*").alias("files"), F.min("file_id").alias("first_id"), F.max("file_id").alias("last_id"), F.sum("size").alias("bytes"))
        counts = counts.join(now["media_source"], "source_id").select(F.lit(version).alias("version"), "source_id", "root", "files", "first_id", "last_id", "bytes")
        every = counts if every is None else every.union(counts)
    return every


INVENTORIES_SQL = """,
counts AS (SELECT source_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY source_id),
ends AS (SELECT *, CAST(sum(files) OVER (ORDER BY source_id) AS BIGINT) AS last_id FROM counts)
SELECT CAST(version AS INTEGER) AS version, source_id, '/media/' || source_id AS root, files, last_id - files + 1 AS first_id, last_id, bytes FROM ends JOIN range(1, 5) v(version) ON source_id <= version"""

def scanned_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of exports that stand in files, read by byte ranges. A folder for each of the 16 exports holds one file."""
    path = scratch_path(spark, "exports")
    lines = chat_exports(spark, sf_dir).select((F.col("doc") % 16).alias("export"), "doc", F.regexp_replace("value", r"\n\z", "").alias("value"))
    # a task for each export here, which is how an export comes to be one file
    lines.repartition(16, "export").sortWithinPartitions("export", "doc").select("export", "value").write.partitionBy("export").text(path)
    rows = parse_lines(scan_exports(spark, path))
    return rows.select(F.regexp_extract("doc", "export=([0-9]+)", 1).cast("long").alias("export"), "sequence_number", "message_type", "sender", "content", "is_placeholder")


SCANNED_SQL = """
WITH said AS (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 7 = 0 THEN '<Media omitted>' ELSE text END AS content
              FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL)
SELECT conv_id % 16 AS export, row_number() OVER (PARTITION BY conv_id % 16 ORDER BY conv_id, turn)::INT AS sequence_number, 'User' AS message_type,
       role AS sender, content, content = '<Media omitted>' AS is_placeholder FROM said"""

QUERIES: dict[str, Query] = {"linked_in_batches": linked_in_batches, "imported_in_parts": imported_in_parts, "inventories_by_version": inventories_by_version, "scanned_messages": scanned_messages}
ORACLE_SQL: dict[str, str] = {"linked_in_batches": oracle(LINKED_SQL), "imported_in_parts": IMPORTED_SQL, "inventories_by_version": oracle(INVENTORIES_SQL), "scanned_messages": SCANNED_SQL}
