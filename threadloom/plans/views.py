"""Archive tables laid over the driver's tables, in Spark and as SQL for the oracle.

The driver has no chat or media tables, so files are made from ``events`` and attachments from ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.names import extension, media_type
from threadloom.sources.chats import PLACEHOLDER

#: Which sources are one device.
DEVICE_GROUPS = {1: 501, 2: 501, 3: 502, 4: 503}
#: The participant whose messages are outgoing.
LOCAL = 1
#: The sender of ``system`` turns where every attachment must have one.
SYSTEM = 3
#: How all rows are laid over dates. Under DENSE, files keep the dates of the events and messages fall on 36 dates, so
#: that every date has very many of both. Under the others dates grow in number with the rows: so many files a date in
#: a row, and each conversation on its own dates (a date for two turns under ORDER, one for all under GATE).
DENSE, ORDER, GATE = 0, 4, 60
#: Dates begin here again after so many.
DATES = 2_500_000


def media_files(spark: SparkSession, sf_dir: str, dates: int = DENSE) -> DataFrame:
    """file_id, source_id, asset_id, name, file_date, is_sent, size, ext, media_type (of the asset)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    error = F.col("event_type") == "error"
    prefix = F.when(F.col("event_type") == "click", "IMG").when(F.col("event_type") == "view", "VID").when(F.col("event_type") == "purchase", "PTT").otherwise("DOC")
    ending = F.when(F.col("event_type") == "click", ".jpg").when(F.col("event_type") == "view", ".mp4").when(F.col("event_type") == "purchase", ".opus").otherwise(".pdf")
    day = F.expr(f"date_add(date '2000-01-01', cast((event_id div {dates}) % {DATES} as int))") if dates else F.col("ts").cast("date")
    number = F.lpad(((F.col("event_id") * 31) % 260).cast("string"), 4, "0")
    copy = F.when(F.col("event_id") % 11 == 0, " (1)").otherwise("")
    name = F.when(error, F.concat(F.lit("note-"), F.col("event_id").cast("string"), F.lit(".txt"))).otherwise(F.concat(prefix, F.lit("-"), F.date_format(day, "yyyyMMdd"), F.lit("-WA"), number, copy, ending))
    half = F.expr("event_id div 2")
    rows = e.select(
        (F.col("event_id") + 1).alias("file_id"),
        (F.col("user_id") % 4 + 1).alias("source_id"),
        (half + 1).alias("asset_id"),
        name.alias("name"),
        F.when(~error, day).alias("file_date"),
        F.when(F.col("user_id") % 4 != 3, F.col("event_id") % 5 < 2).alias("is_sent"),
        F.when(half % 97 == 0, 0).otherwise(1024).cast("long").alias("size"),
    )
    rows = rows.withColumn("ext", extension(F.col("name")))
    return rows.withColumn("media_type", media_type(F.col("ext"), F.col("size")))


def attachments(spark: SparkSession, sf_dir: str, dates: int = DENSE) -> DataFrame:
    """attachment_id, sequence_number, message_date, sender_id (1 is local, null unknown)."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    # any number that orders messages serves; a sum over the key's range avoids ranking all rows in one task
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("attachment_id"),
        (F.col("conv_id") * 100 + F.col("turn") + 1).alias("sequence_number"),
        F.expr(f"date_add(date '{_FIRST[dates]}', cast({_MESSAGE_DAY[dates].replace('//', 'div')} as int))").alias("message_date"),
        F.when(F.col("role") == "user", F.lit(LOCAL)).when(F.col("role") == "assistant", F.lit(2)).cast("long").alias("sender_id"),
    )


def sent_attachments(spark: SparkSession, sf_dir: str, dates: int = DENSE) -> DataFrame:
    """All attachments, each with a sender: ``system`` turns have one of their own (``SYSTEM``)."""
    return attachments(spark, sf_dir, dates).withColumn("sender_id", F.coalesce("sender_id", F.lit(SYSTEM).cast("long")))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message_id, conversation_id (1 or 2), sequence_number, message_time as text, sender_id; every turn is a message."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("message_id"),
        (F.col("conv_id") % 2 + 1).alias("conversation_id"),
        (F.col("conv_id") * 100 + F.col("turn") + 1).alias("sequence_number"),
        F.date_format(F.expr(f"date_add(date '{_FIRST[DENSE]}', cast({_MESSAGE_DAY[DENSE]} as int))"), "yyyy-MM-dd'T'10:00:00").alias("message_time"),
        F.when(F.col("role") == "user", F.lit(LOCAL)).when(F.col("role") == "assistant", F.lit(2)).cast("long").alias("sender_id"),
    )


def message_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attachment_id, message_id, ordinal, status of all messages' attachments: one turn in three has none, of the others one
    in five has two; one in seven is resolved."""
    none, one, two = (F.array(*[F.lit(i) for i in x]).cast("array<int>") for x in ((), (1,), (1, 2)))
    ordinals = F.when(F.col("message_id") % 3 == 0, none).when(F.col("message_id") % 5 == 0, two).otherwise(one)
    linked = messages(spark, sf_dir).select("message_id", F.explode(ordinals).alias("ordinal"))
    status = F.when((F.col("message_id") + F.col("ordinal")) % 7 == 0, "Resolved").otherwise("Unresolved")
    return linked.select((F.col("message_id") * 10 + F.col("ordinal")).alias("attachment_id"), "message_id", "ordinal", status.alias("status"))


def chat_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, value): each conversation as an exported chat; roles are senders, and every turn has its own minute. One turn in
    seven has lost its media."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id is not null and role is not null and text is not null")
    stamp = F.date_format(F.expr("timestamp '2026-01-05 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(turn as int), 0)"), "yyyy/MM/dd, HH:mm")
    said = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, PLACEHOLDER).otherwise(F.col("text"))
    line = F.concat(stamp, F.lit(" - "), "role", F.lit(": "), said, F.lit("\n"))
    return c.groupBy(F.col("conv_id").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "").alias("value"))


def device_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(DEVICE_GROUPS.items()), "source_id long, group_id long")


_FIRST = {DENSE: "2023-12-30", ORDER: "2000-01-01", GATE: "2000-01-01"}
_MESSAGE_DAY = {DENSE: "(conv_id * 13 + turn) % 36", ORDER: f"(conv_id * 10 + turn // 2) % {DATES}", GATE: f"conv_id % {DATES}"}

_NAME = """CASE WHEN event_type = 'error' THEN 'note-' || event_id || '.txt' ELSE
 (CASE event_type WHEN 'click' THEN 'IMG' WHEN 'view' THEN 'VID' WHEN 'purchase' THEN 'PTT' ELSE 'DOC' END) || '-' || strftime(day, '%Y%m%d') || '-WA'
 || lpad(CAST((event_id * 31) % 260 AS VARCHAR), 4, '0') || (CASE WHEN event_id % 11 = 0 THEN ' (1)' ELSE '' END)
 || (CASE event_type WHEN 'click' THEN '.jpg' WHEN 'view' THEN '.mp4' WHEN 'purchase' THEN '.opus' ELSE '.pdf' END) END"""

_FILES = f"""f0 AS (SELECT event_id + 1 AS file_id, user_id % 4 + 1 AS source_id, (event_id // 2) + 1 AS asset_id, {_NAME} AS name,
 CASE WHEN event_type <> 'error' THEN day END AS file_date, CASE WHEN user_id % 4 <> 3 THEN event_id % 5 < 2 END AS is_sent,
 CASE WHEN (event_id // 2) % 97 = 0 THEN 0 ELSE 1024 END AS size, event_type FROM (SELECT *, %day AS day FROM events)),
f1 AS (SELECT *, CASE WHEN event_type = 'error' THEN '.txt' WHEN event_type = 'click' THEN '.jpg' WHEN event_type = 'view' THEN '.mp4' WHEN event_type = 'purchase' THEN '.opus' ELSE '.pdf' END AS ext FROM f0),
files AS (SELECT *, CASE WHEN size = 0 THEN 'Unknown' WHEN ext = '.jpg' THEN 'Image' WHEN ext = '.mp4' THEN 'Video' WHEN ext = '.opus' THEN 'Audio' ELSE 'Document' END AS media_type,
 CASE WHEN file_date IS NOT NULL THEN substr(name, instr(name, '-WA') + 3, length(name) - instr(name, '-WA') - 2 - length(ext)) END AS suffix FROM f1),
tokens AS (SELECT *, CASE WHEN regexp_full_match(suffix, '[0-9]{{4}}') THEN CAST(suffix AS INTEGER) END AS token FROM files)"""

_ATTACHMENTS = """attachments AS (SELECT conv_id * 100 + turn AS attachment_id, conv_id * 100 + turn + 1 AS sequence_number,
 CAST(DATE '%first' + CAST(%message_day AS INTEGER) AS DATE) AS message_date,
 CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 END AS sender_id FROM conversations),
sent AS (SELECT * REPLACE (coalesce(sender_id, 3) AS sender_id) FROM attachments)"""

_GROUPS = "device_groups AS (SELECT * FROM (VALUES (1, 501), (2, 501), (3, 502), (4, 503)) g(source_id, group_id))"


def oracle(body: str, dates: int = DENSE, message_dates: int | None = None) -> str:
    """``body`` (further WITH parts and a SELECT) over the views files, tokens, attachments, sent (the same, each with a sender) and device_groups; messages lie
    over the files' kind of dates, or over another."""
    said = dates if message_dates is None else message_dates
    day = f"CAST(DATE '2000-01-01' + CAST((event_id // {dates}) % {DATES} AS INTEGER) AS DATE)" if dates else "CAST(ts AS DATE)"
    views = f"{_FILES},\n{_ATTACHMENTS},\n{_GROUPS}".replace("%day", day).replace("%first", _FIRST[said]).replace("%message_day", _MESSAGE_DAY[said])
    return f"WITH {views}{body}"


#: The views messages and linked (attachments of messages, up to two each).
MESSAGE_SQL = f"""messages AS (SELECT conv_id * 100 + turn AS message_id, conv_id % 2 + 1 AS conversation_id, conv_id * 100 + turn + 1 AS sequence_number,
 CAST(DATE '{_FIRST[DENSE]}' + CAST({_MESSAGE_DAY[DENSE]} AS INTEGER) AS DATE) AS message_date, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 END AS sender_id FROM conversations),
linked AS (SELECT message_id * 10 + ordinal AS attachment_id, message_id, ordinal, CASE WHEN (message_id + ordinal) % 7 = 0 THEN 'Resolved' ELSE 'Unresolved' END AS status
 FROM messages, (VALUES (1), (2)) o(ordinal) WHERE message_id % 3 <> 0 AND (ordinal = 1 OR message_id % 5 = 0))"""
