"""Chat exports as text, parsed into ordered messages.

``read_exports`` takes each file as one row, for many small ones. ``scan_exports`` reads byte ranges of files in parallel,
so that one file of any size is many tasks: a first scan counts lines and headers of every range, sums over the ranges
before say with which line and which message each begins, and the second scan counts on from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The shape that opens a message, its timestamp, direction marks to strip, and the placeholder of lost media.
HEADER = r"\A[0-9]{4}/[0-9]{2}/[0-9]{2}, [0-9]{2}:[0-9]{2} - "
STAMP = "yyyy/MM/dd, HH:mm"
MARKS = "‎‏"
PLACEHOLDER = "<Media omitted>"


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """(doc, value): each export file as one text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), "value")


def _counted_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append the number of each line in its range, and how many headers the range has had so far."""
    at, line, message = None, 0, 0
    for batch in batches:
        # a task reads its ranges one after another
        keys = list(zip(batch["doc"].to_pylist(), batch["begin"].to_pylist(), strict=True))
        cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if keys[i] != at:
                at, line, message = keys[i], 0, 0
            part = batch.slice(i, j - i)
            lines, messages = line + 1 + np.arange(j - i), message + np.cumsum(part["opens"].to_numpy(zero_copy_only=False))
            line, message = int(lines[-1]), int(messages[-1])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lines, pa.int64()), pa.array(messages, pa.int64())], [*part.schema.names, "lines", "messages"])


#: Ranges whose sums are sent to all tasks; more are joined.
SENT_RANGES = 100_000


def scan_exports(spark: SparkSession, path: str) -> DataFrame:
    """(doc, line, raw, text, opens, message): all lines of all export files below ``path``, for ``parse_lines``.

    Files are split as ``spark.sql.files.maxPartitionBytes`` says, and the result is the same for every size. Lines end with
    a line feed, a carriage return or both. Nothing is shuffled; a row for each range is summed within its file.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").alias("raw"))
    read = read.withColumn("text", F.translate("raw", MARKS, "")).withColumn("opens", F.col("text").rlike(HEADER))
    ranges = read.groupBy("doc", "begin").agg(F.count("*").alias("n"), F.count_if("opens").alias("headers"))
    before = Window.partitionBy("doc").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("doc", "begin", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "headers")])
    sums = F.broadcast(ranges) if spark.read.text(path).rdd.getNumPartitions() <= SENT_RANGES else ranges
    counted = read.mapInArrow(_counted_on, "doc string, begin long, raw string, text string, opens boolean, lines long, messages long")
    line, message = F.col("lines") + F.col("n_before"), F.col("messages") + F.col("headers_before")
    return counted.join(sums, ["doc", "begin"]).select("doc", line.cast("int").alias("line"), "raw", "text", "opens", message.alias("message"))


def _lines(exports: DataFrame) -> DataFrame:
    rows = exports.select("doc", F.posexplode(F.split(F.regexp_replace("value", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")).alias("at", "raw"))
    rows = rows.select("doc", (F.col("at") + 1).alias("line"), "raw", F.translate("raw", MARKS, "").alias("text"))
    rows = rows.withColumn("opens", F.col("text").rlike(HEADER))
    return rows.withColumn("message", F.sum(F.col("opens").cast("int")).over(Window.partitionBy("doc").orderBy("line")))


def _header(text):
    rest = F.substring(text, F.lit(21), F.length(text))
    return F.try_to_timestamp(F.substring(text, 1, 17), F.lit(STAMP)).cast("timestamp_ntz"), rest, F.instr(rest, ": ")


def parse_problems(exports: DataFrame) -> DataFrame:
    """(doc, line, problem) of what makes an export unreadable, without its content.

    A header with an impossible time, one with an empty sender, and text before the first message. Blank lines there
    are none.
    """
    return line_problems(_lines(exports))


def line_problems(lines: DataFrame) -> DataFrame:
    """The same of lines, as ``scan_exports`` gives them."""
    return lines.select("doc", "line", _problem().alias("problem")).where("problem is not null")


def _problem():
    at, _, colon = _header(F.col("text"))
    return F.when(F.col("opens") & at.isNull(), "ImpossibleTime").when(F.col("opens") & (colon == 1), "EmptySender").when((F.col("message") == 0) & ~F.col("text").rlike(r"(?U)\A\s*\z"), "TextBeforeFirstMessage")


def parse_messages(exports: DataFrame, strict: bool = True) -> DataFrame:
    """(doc, sequence_number, message_time, message_type, sender, content, raw_content, line_start, line_end, is_placeholder).

    Lines without a header go on the message before. A header without ``": "`` is a system message. What
    ``parse_problems`` names is an error that tells the line and not its content; if not ``strict``, an impossible time is
    null and the rest is read as far as it goes. A null or empty text has no messages.
    """
    return parse_lines(_lines(exports), strict)


def parse_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """What ``parse_messages`` returns, from lines as ``scan_exports`` gives them. A message is folded in one task."""
    at, rest, colon = _header(F.col("text"))
    use = F.col("message") > 0
    if strict:
        bad = _problem()
        use = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), bad)).cast("boolean")).otherwise(use)
    said = F.when(colon > 1, F.substring(rest, colon + 2, F.length(rest))).otherwise(rest)
    rows = lines.where(use).select(
        "doc", "message", "line", "opens", "raw", F.when(F.col("opens"), said).otherwise(F.col("text")).alias("content"),
        F.when(F.col("opens"), at).alias("time"), F.when(F.col("opens") & (colon > 1), F.substring(rest, F.lit(1), colon - 1)).alias("sender"),
    )
    folded = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", c))), lambda x: x[c]), "\n")
    out = rows.groupBy("doc", "message").agg(folded("content").alias("content"), folded("raw").alias("raw_content"), F.max("time").alias("message_time"), F.max("sender").alias("sender"), F.min("line").alias("line_start"), F.max("line").alias("line_end"))
    return out.select("doc", F.col("message").cast("int").alias("sequence_number"), "message_time", F.when(F.col("sender").isNull(), "System").otherwise("User").alias("message_type"), "sender", "content", "raw_content", "line_start", "line_end", (F.col("content") == PLACEHOLDER).alias("is_placeholder"))
