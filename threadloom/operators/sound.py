"""Rules that a row shows by itself, checked in the pass in which an analysis reads it.

The analyses over files and attachments read them through these. The job fails at the first row that breaks a rule, so
nothing is said about an archive that isn't sound, and no second scan is needed to know. What only several rows show
together is in ``guards``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.names import marker_date, once


def _refuse(rows: DataFrame, subject: str, rules: dict[str, Column]) -> DataFrame:
    """``rows`` as they are; an error that names the rule and the number of the row that breaks it."""
    broken = reduce(lambda seen, rule: seen.when(rule[1], F.lit(rule[0])), rules.items(), F.when(F.lit(False), F.lit("")))
    told = F.concat(F.lit("the archive breaks "), broken, F.lit(": "), F.coalesce(F.col(subject).cast("string"), F.lit("no number")))
    return rows.where(F.when(broken.isNotNull(), F.raise_error(told).cast("boolean")).otherwise(F.lit(True)))


def sound_files(files: DataFrame) -> DataFrame:
    """The files; none without a number, with a negative size, or with a date that isn't the one in its name."""
    have, rules = set(files.columns), {}
    if "file_id" in have:
        rules["file_without_number"] = F.col("file_id").isNull()
    if "size" in have:
        rules["negative_size"] = F.col("size") < 0
    if {"name", "file_date"} <= have:
        said = F.col("__said")
        rules["dated_file_without_marker"] = F.col("file_date").isNotNull() & said.isNull()
        rules["marker_differs_from_date"] = F.col("file_date") != said
        # names are searched once a row, not once for each place at which the rules name the date
        return _refuse(files.select("*", once(__said=marker_date(F.col("name")))), "file_id", rules).drop("__said") if "file_id" in have else files
    return _refuse(files, "file_id", rules) if "file_id" in have else files


def sound_attachments(attachments: DataFrame) -> DataFrame:
    """The attachments; none without a number, a date or a place in the order of messages."""
    have = set(attachments.columns)
    if "attachment_id" not in have:
        return attachments
    rules = {"attachment_without_number": F.col("attachment_id").isNull()}
    rules |= {f"attachment_without_{c}": F.col(c).isNull() for c in ("message_date", "sequence_number") if c in have}
    return _refuse(attachments, "attachment_id", rules)
