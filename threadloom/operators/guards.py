"""Integrity guards: each a table of what violates one rule. An analysis should run only where all of them are empty.

Every guard returns (guard string, subject string): the rule, and the number or name of what breaks it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.names import marker_date, once
from threadloom.operators.evidence import evidence_by_asset_date
from threadloom.operators.scope import KEY_LEVELS, ambiguity, assets_in_collisions

#: How dates and times are stored.
DATE_FORMAT, TIME_FORMAT = (r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z", "yyyy-MM-dd"), (r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\z", "yyyy-MM-dd'T'HH:mm:ss")


def _said(rows: DataFrame, guard: str, subject: str | Column) -> DataFrame:
    subject = F.col(subject) if isinstance(subject, str) else subject
    return rows.select(F.lit(guard).alias("guard"), subject.cast("string").alias("subject"))


def _broken(rows: DataFrame, subject: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks, from one pass over the rows."""
    guards = F.array_compact(F.array(*[F.when(test, F.lit(guard)) for guard, test in rules.items()]))
    return rows.select(F.explode(guards).alias("guard"), F.col(subject).cast("string").alias("subject"))


def together(*guards: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, guards)


def counts(violations: DataFrame) -> DataFrame:
    """(guard, violations) of the guards that are broken."""
    return violations.groupBy("guard").agg(F.count("*").alias("violations"))


def require(violations: DataFrame) -> None:
    """Raise, naming the broken guards and how often, if there is a violation."""
    found = {r["guard"]: r["violations"] for r in counts(violations).collect()}  # a row for each guard
    if found:
        raise ValueError(f"the archive breaks {found}")


def repeated(rows: DataFrame, key: list[str], guard: str) -> DataFrame:
    """Keys that stand in several rows."""
    many = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return _said(many, guard, F.concat_ws(",", *[F.col(k).cast("string") for k in key]))


def missing(rows: DataFrame, key: str, of: DataFrame, guard: str, of_key: str | None = None) -> DataFrame:
    """Values of ``key`` that ``of`` doesn't have; a null refers to nothing."""
    there = of.select(F.col(of_key or key).alias(key)).distinct()
    return _said(rows.where(F.col(key).isNotNull()).join(there, key, "left_anti"), guard, key)


def ill_formed(rows: DataFrame, column: str, stored: tuple[str, str], subject: str, guard: str) -> DataFrame:
    """Texts that aren't exactly of the stored shape, or no date."""
    shape, pattern = stored
    good = F.col(column).rlike(shape) & F.try_to_timestamp(F.col(column), F.lit(pattern)).isNotNull()
    return _said(rows.where(F.col(column).isNotNull() & ~good), guard, subject)


def media_guards(files: DataFrame, links: DataFrame, assets: DataFrame) -> DataFrame:
    """Files unhashed, without a link to an asset that is there, of another hash than their asset's, or linked twice.

    ``files`` (file_id, sha256), ``links`` (file_id, asset_id), ``assets`` (asset_id, sha256).
    """
    files = files.select("file_id", "sha256")
    linked = files.join(links.select("file_id", "asset_id"), "file_id", "left").join(assets.select("asset_id", F.col("sha256").alias("asset_sha256")), "asset_id", "left")
    hashed = F.col("sha256").isNotNull()
    return together(
        _said(files.where("sha256 is null"), "unhashed_file", "file_id"),
        _broken(linked, "file_id", {"hashed_file_without_asset": hashed & F.col("asset_sha256").isNull(), "hash_differs_from_asset": hashed & (F.upper("sha256") != F.upper("asset_sha256"))}),
        repeated(links, ["file_id"], "several_assets_of_a_file"),
    )


def date_guards(files: DataFrame, dated_sources: DataFrame) -> DataFrame:
    """Dated files without a marker or with another date in it; undated files of a dated source that have a marker.

    ``files`` (file_id, source_id, name, file_date), ``dated_sources`` (source_id).
    """
    f = files.select("file_id", "source_id", "file_date", once(said=marker_date(F.col("name"))))
    f = f.join(dated_sources.select("source_id").distinct().withColumn("of_dated", F.lit(True)), "source_id", "left")
    dated, said = F.col("file_date").isNotNull(), F.col("said")
    return _broken(f, "file_id", {"dated_file_without_marker": dated & said.isNull(), "marker_differs_from_date": F.col("file_date") != said, "undated_file_with_marker": ~dated & said.isNotNull() & F.col("of_dated")})


def conversation_guards(spark_rows: DataFrame, conversations: DataFrame, participants: DataFrame) -> DataFrame:
    """Requests (conversation_id, local_id) whose conversation isn't there, or whose local participant isn't in it."""
    asked = spark_rows.select("conversation_id", "local_id")
    own = participants.select("conversation_id", F.col("participant_id").alias("local_id"))
    strangers = asked.where("local_id is not null").join(own, ["conversation_id", "local_id"], "left_anti")
    return together(missing(asked, "conversation_id", conversations, "no_such_conversation"), _said(strangers, "local_participant_of_another_conversation", "local_id"))


def group_guards(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Sources mapped twice, not at all, or mapped without being there; an empty map."""
    sources = files.select("source_id").distinct()
    empty = groups.agg(F.count("*").alias("n")).where("n = 0")
    return together(repeated(groups, ["source_id"], "source_mapped_twice"), missing(sources, "source_id", groups, "source_not_mapped"), missing(groups, "source_id", sources, "unknown_source_mapped"), _said(empty, "no_device_groups", F.lit("")))


def reconciliation_guards(files: DataFrame, rows: DataFrame, locality: DataFrame) -> DataFrame:
    """Totals that must add up: files with and without a token are the dated ones, locality classes are the assets."""
    dated = files.agg(F.count("file_date").alias("dated"), F.count("*").alias("files"), F.count(F.when(F.col("file_date").isNull(), 1)).alias("undated"))
    both = dated.crossJoin(rows.agg(F.count("*").alias("tokens")))  # of one row each
    classes = locality.where("assets <> within_source_and_date + within_group_and_date + across_groups + across_dates")
    return together(_said(both.where("tokens > dated or dated + undated <> files"), "files_do_not_add_up", "dated"), _said(classes, "locality_does_not_add_up", "assets"))


def monotone_guards(rows: DataFrame) -> DataFrame:
    """Levels at which ambiguity grows although their key is finer than that of the level before."""
    order = list(KEY_LEVELS)
    m = ambiguity(rows).where("with_empty").select("level", "multi_asset_keys", "files_in_multi_asset_keys").join(assets_in_collisions(rows).where("with_empty").select("level", F.col("assets").alias("colliding")), "level", "left").na.fill(0)
    flat = m.select(F.create_map(*[F.lit(x) for i, k in enumerate(order) for x in (k, i)])[F.col("level")].alias("at"), "level", "files_in_multi_asset_keys", "colliding")
    before = flat.select((F.col("at") + 1).alias("at"), F.col("files_in_multi_asset_keys").alias("files_before"), F.col("colliding").alias("colliding_before"))
    return _said(flat.join(before, "at").where("files_in_multi_asset_keys > files_before or colliding > colliding_before"), "finer_key_more_ambiguous", "level")


def cohort_guards(attachments: DataFrame, groups: DataFrame, files: DataFrame) -> DataFrame:
    """Of attachments and ``cohort_groups``: repeated sequence numbers, groups with several assets, an asset of both
    directions on a date, and groups whose asset has no copy of that date or one of the other direction."""
    several = groups.where("asset_id <> last_asset_id")
    both = groups.groupBy("message_date", "asset_id").agg(F.countDistinct("direction").alias("n")).where("n > 1")
    e = evidence_by_asset_date(files).select("asset_id", F.col("file_date").alias("message_date"), "has_sent", "has_not_sent")
    seen = groups.join(e, ["asset_id", "message_date"], "left")
    opposite = F.when(F.col("direction") == "Outgoing", F.col("has_not_sent")).otherwise(F.col("has_sent"))
    return together(
        repeated(attachments, ["sequence_number"], "sequence_number_repeated"), _said(several, "several_assets_of_a_group", "asset_id"), _said(both, "asset_of_both_directions", "asset_id"),
        _broken(seen, "asset_id", {"candidate_not_observed": F.col("has_sent").isNull(), "copy_of_the_other_direction": opposite}),
    )


def gate_guards(attachments: DataFrame, files: DataFrame, tokens: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Attachments without a sender; and where counts were ``declared`` (source_id, files, tokens), sources whose
    counts differ, or that only one side has."""
    out = _said(attachments.where("sender_id is null"), "attachment_without_sender", "attachment_id")
    if declared is None:
        return out
    seen = files.groupBy("source_id").agg(F.count("*").alias("seen_files")).join(tokens.groupBy("source_id").agg(F.count("*").alias("seen_tokens")), "source_id", "left").na.fill(0)
    both = seen.join(declared, "source_id", "full_outer")
    wrong = both.where("seen_files is null or files is null or seen_files <> files or seen_tokens <> tokens")
    return together(out, _said(wrong, "declared_counts_differ", "source_id"))


def import_guards(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """Import requests (doc, source_type, display_name, file_name, title, time_zone) with a blank field or a folder in the
    file name or without messages; messages (doc, sequence_number, message_type, sender) of a user without a sender or the reverse."""
    fields = ("source_type", "display_name", "file_name", "title", "time_zone")
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(c)) == "", F.lit(True)) for c in fields])
    sides = (F.col("message_type") == "User") != F.col("sender").isNotNull()
    return together(
        _said(requests.where(blank), "blank_field", "doc"), _said(requests.where(F.col("file_name").rlike(r"[/\\]")), "file_name_with_folder", "doc"),
        _said(requests.join(messages.select("doc").distinct(), "doc", "left_anti"), "import_without_messages", "doc"), _said(messages.where(sides), "sender_against_type", F.concat_ws(",", F.col("doc").cast("string"), F.col("sequence_number").cast("string"))),
    )


def root_guards(roots: DataFrame, files: DataFrame) -> DataFrame:
    """Roots (source_id, root) of which one holds another, and those without files. A root meets its own prefixes only."""
    clean = F.regexp_replace(F.replace("root", F.lit("\\"), F.lit("/")), "/+$", "")
    r = roots.select("source_id", clean.alias("root"))
    steps = F.split("root", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    above = r.select("source_id", F.explode(prefixes).alias("prefix")).join(r.select(F.col("source_id").alias("other"), F.col("root").alias("prefix")), "prefix").where("source_id <> other")
    inside = above.select(F.explode(F.array("source_id", "other")).alias("source_id")).distinct()
    return together(_said(inside, "roots_overlap", "source_id"), _said(r.join(files.select("source_id").distinct(), "source_id", "left_anti"), "source_without_files", "source_id"))


def constraint_guards(tables: dict[str, DataFrame], keys: dict[str, list[list[str]]], references: list[tuple[str, str, str, str]], checks: dict[str, dict[str, str]]) -> DataFrame:
    """Relational constraints: unique keys by table, references (table, column, table, column), and conditions (SQL) by
    table and name that must not be false."""
    found = [repeated(tables[t], key, f"{t}: {', '.join(key)} repeated") for t, of in keys.items() for key in of]
    found += [missing(tables[t], c, tables[u], f"{t}: no such {c}", d) for t, c, u, d in references]
    found += [_said(tables[t].where(f"not ({test})"), f"{t}: {name}", F.lit("")) for t, of in checks.items() for name, test in of.items()]
    return together(*found)
