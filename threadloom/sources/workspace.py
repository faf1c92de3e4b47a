"""The archive's workspace: imported conversations as tables, and its tables on disk with a version."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.sources.chats import PLACEHOLDER

#: Fixed value: the version of the tables.
VERSION = 2


def participants(messages: DataFrame) -> DataFrame:
    """(doc, participant_id, name): one for each different sender of a user message, numbered by first appearance.

    Senders are few; those of one export are numbered in one task.
    """
    first = messages.where("message_type = 'User'").groupBy("doc", "sender").agg(F.min("sequence_number").alias("at"))
    return first.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("at")).cast("long").alias("participant_id"), F.col("sender").alias("name"))


def imported_messages(messages: DataFrame, people: DataFrame) -> DataFrame:
    """The messages with the participant that sent them; system messages have none."""
    who = people.select("doc", F.col("name").alias("sender"), "participant_id")
    return messages.join(who, ["doc", "sender"], "left").select("doc", "sequence_number", "message_type", F.when(F.col("message_type") == "User", F.col("participant_id")).alias("participant_id"), "content")


def placeholder_attachments(messages: DataFrame) -> DataFrame:
    """(doc, sequence_number, ordinal, status): an unresolved attachment for each message that is exactly the placeholder.

    The migration of old workspaces fills their attachments by the same rule.
    """
    return messages.where(F.col("content") == PLACEHOLDER).select("doc", "sequence_number", F.lit(1).alias("ordinal"), F.lit("Unresolved").alias("status"))


def unresolved(linked: DataFrame, messages: DataFrame, conversation_id: int | None = None) -> DataFrame:
    """Unresolved attachments with their messages, of one conversation or of all."""
    rows = linked.where("status = 'Unresolved'").join(messages, "message_id")
    return rows.where(F.col("conversation_id") == conversation_id) if conversation_id is not None else rows


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_workspace(tables: dict[str, DataFrame], path: str) -> None:
    """Write all tables, or none: they are written beside ``path`` and moved there once all are complete."""
    spark = next(iter(tables.values())).sparkSession
    target, system = _file(spark, path)
    if system.exists(target):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.partial"
    system.delete(_file(spark, staging)[0], True)
    for name, table in tables.items():
        table.write.parquet(f"{staging}/{name}")
    spark.createDataFrame([(json.dumps({"version": VERSION, "tables": sorted(tables)}),)], "value string").coalesce(1).write.text(f"{staging}/_workspace")
    if not system.rename(_file(spark, staging)[0], target):
        raise OSError(f"{staging} could not be moved to {path}")


def read_workspace(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a workspace; one that isn't there, or of another version, is refused."""
    target, system = _file(spark, f"{path}/_workspace")
    if not system.exists(target):
        raise FileNotFoundError(f"{path} is no workspace")
    said = json.loads(spark.read.text(f"{path}/_workspace").first()["value"])
    if said["version"] != VERSION:
        raise ValueError(f"{path} has version {said['version']}, not {VERSION}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in said["tables"]}
