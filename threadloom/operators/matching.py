"""Which assets could be the media that attachments lost: candidates by date and direction, and their census.

Counting never lists candidates: assets of a date are counted by their direction flags first, so an attachment meets
at most eight rows, however many assets its date has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.names import CANDIDATE_BANDS, band
from threadloom.operators.evidence import any_of, asset_facts, date_density, evidence_by_asset_date, source_facts, undated_pools
from threadloom.session import materialize
from threadloom.sources.workspace import unresolved
from threadloom.operators.sound import sound_attachments, sound_files

#: How candidates agree with a message's direction.
STATES = ("Compatible", "Mixed", "Unknown", "ContradictoryOnly")


def direction(sender: Column, local: int | None) -> Column:
    if local is None:
        return F.lit("Unknown")
    return F.when(sender.isNull(), "Unknown").when(sender == local, "Outgoing").otherwise("Incoming")


def known_direction(sender: Column, local: int | None) -> Column:
    """The direction, where one that can't be told is an error."""
    side = direction(sender, local)
    return F.when(side == "Unknown", F.raise_error(F.lit("an attachment without a sender")).cast("string")).otherwise(side)


def compatibility(direction_: Column, has_sent: Column, has_not_sent: Column) -> Column:
    agrees = F.when(direction_ == "Outgoing", has_sent).otherwise(has_not_sent)
    differs = F.when(direction_ == "Outgoing", has_not_sent).otherwise(has_sent)
    return F.when(direction_ == "Unknown", "Unknown").when(agrees & differs, "Mixed").when(agrees, "Compatible").when(differs, "ContradictoryOnly").otherwise("Unknown")


#: A block has so many assets of a date at most, give or take what hashes differ by; a task has so many in all its blocks.
PER_BLOCK, PER_TASK = 8192, 16_384
#: Runs of so many attachments and assets meet. Parquet packs 504 values at a time, so a run of assets that comes again
#: repeats its bytes, which every codec shortens.
SAID_RUN, RUN = 80, 504


def _blocks(assets: DataFrame) -> tuple[DataFrame, int]:
    """(message_date, blocks) of the dates with more assets than a block takes, and the tasks to deal all blocks to."""
    n = assets.count()
    per_date = assets.groupBy("message_date").agg(F.count("*").alias("n")).where(F.col("n") > PER_BLOCK)
    # as many tasks as asked for, however few bytes they read: what they write is far more
    tasks = max(int(assets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // PER_TASK))
    return per_date.select("message_date", F.ceil(F.col("n") / PER_BLOCK).cast("int").alias("blocks")), tasks


def _dealt(attachments: DataFrame, assets: DataFrame, blocks: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Both with a block: an asset is in one block of its date, and an attachment in all."""
    several = F.coalesce("blocks", F.lit(1))
    said = attachments.join(F.broadcast(blocks), "message_date", "left").withColumn("block", F.explode(F.sequence(F.lit(0), several - 1))).drop("blocks")
    dealt = assets.join(F.broadcast(blocks), "message_date", "left").withColumn("block", F.pmod(F.xxhash64("asset_id"), several).cast("int")).drop("blocks")
    return said, dealt.repartition(tasks, "message_date", "block")


def _met(attachments: DataFrame, assets: DataFrame, told: list[str], blocks: DataFrame, tasks: int) -> DataFrame:
    """Each attachment (..., message_date, direction) with what is ``told`` of each asset of its date, and their compatibility.

    There can be as many as the product of both, so nothing is shuffled or held after they meet, and rows come in an order
    that is short when written: alike assets stand together in runs, and each attachment of a run meets the whole run.
    """
    said, dealt = _dealt(attachments, assets, blocks, tasks)
    own = [c for c in attachments.columns if c not in ("message_date", "direction")]
    many = _in_runs(said.repartition(tasks, "message_date", "block"), ["message_date", "block", "direction"], own, SAID_RUN, F.collect_list(F.struct(*own)).alias("many"))
    alike = [*(c for c in told if c != "asset_id"), "has_sent", "has_not_sent", "asset_id"]
    runs = _in_runs(dealt, ["message_date", "block"], alike, RUN, F.collect_list(F.struct(*told, "has_sent", "has_not_sent")).alias("assets"))
    met = many.drop("run").join(runs.drop("run").hint("merge"), ["message_date", "block"])
    # once for all attachments of a run, which share their direction
    seen = F.transform("assets", lambda x: F.struct(*(x[c].alias(c) for c in told), compatibility(F.col("direction"), x["has_sent"], x["has_not_sent"]).alias("compatibility")))
    each = met.select("message_date", "direction", "many", seen.alias("seen")).select("message_date", "direction", "seen", F.inline("many"))
    return each.select(*attachments.columns, F.inline("seen"))


def _in_runs(rows: DataFrame, keys: list[str], order: list[str], length: int, *collected: Column) -> DataFrame:
    """What is collected of each ``length`` rows of a key, in this order; ``rows`` are dealt by the key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("run", ((place - 1) / length).cast("int")).groupBy(*keys, "run").agg(*collected)


def exact_relations(attachments: DataFrame, files: DataFrame, local: int | None, sources: Column | None = None) -> DataFrame:
    """A row for each attachment and eligible asset with a copy of the message's date.

    ``sources`` says how an asset's are told, once for each asset and date; as an array, if not given.
    """
    e = evidence_by_asset_date(files).withColumnRenamed("file_date", "message_date")
    e = materialize(e.withColumn("sources", F.col("sources") if sources is None else sources), "evidence")
    a = sound_attachments(attachments).select("attachment_id", "sequence_number", "message_date", direction(F.col("sender_id"), local).alias("direction"))
    return _met(a, e, ["asset_id", "media_type", "copies", "sources"], *_blocks(e))


def candidate_details(relations: DataFrame, files: DataFrame) -> DataFrame:
    """The exact relations with what all files say of their asset: copies and sources on any date, and its size."""
    facts = asset_facts(files).select("asset_id", F.col("copies").alias("all_copies"), F.col("sources").alias("all_sources"), "size")
    return relations.select("attachment_id", "asset_id", "media_type", F.col("copies").alias("supporting_copies"), F.size("sources").cast("long").alias("supporting_sources"), "compatibility").join(facts, "asset_id")


#: The first and the last date there is.
FIRST_DATE, LAST_DATE = "0001-01-01", "9999-12-31"


def neighbours(day: Column) -> Column:
    """The days before and after; the first and the last date there is have one neighbour."""
    before = F.when(day > F.lit(FIRST_DATE).cast("date"), F.date_sub(day, 1))
    after = F.when(day < F.lit(LAST_DATE).cast("date"), F.date_add(day, 1))
    return F.filter(F.array(before, after), lambda x: x.isNotNull())


def adjacent_relations(attachments: DataFrame, files: DataFrame, local: int | None) -> DataFrame:
    """A row for each attachment and asset with a copy of the day before or after, but none of the day itself.

    What the days around a date say of an asset is the same for all attachments of the date, so it is put together for
    each asset and date, before attachments meet it.
    """
    e = evidence_by_asset_date(files)
    around = e.select("*", F.explode(F.concat(F.array("file_date"), neighbours(F.col("file_date")))).alias("message_date"))
    near = around.groupBy("asset_id", "message_date").agg(
        F.bool_or(F.col("file_date") == F.col("message_date")).alias("exact"),
        F.bool_or(F.col("file_date") < F.col("message_date")).alias("has_previous"),
        F.bool_or(F.col("file_date") > F.col("message_date")).alias("has_next"),
        F.sum("copies").alias("copies"),
        F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"),
        any_of(F.col("has_sent")).alias("has_sent"),
        any_of(F.col("has_not_sent")).alias("has_not_sent"),
    ).where("not exact").drop("exact")
    near = materialize(near, "near")
    blocks, tasks = _blocks(near)
    rows = sound_attachments(attachments).select("attachment_id", "message_date", "sender_id")
    # numbers that stand on several rows are one attachment, whose dates come together once more
    many = rows.groupBy("attachment_id").agg(F.count("*").alias("n")).where("n > 1").select("attachment_id")
    told = ["asset_id", "has_previous", "has_next", "copies", "sources"]
    once = rows.join(many, "attachment_id", "left_anti").select("attachment_id", "message_date", direction(F.col("sender_id"), local).alias("direction"))
    single = _met(once, near.withColumn("sources", F.size("sources").cast("long")), told, blocks, tasks)
    both = _several_dates(rows.join(many, "attachment_id", "left_semi"), near, local, blocks, tasks)
    return single.select("attachment_id", *told, "compatibility").unionByName(both)


def _several_dates(rows: DataFrame, near: DataFrame, local: int | None, blocks: DataFrame, tasks: int) -> DataFrame:
    """Adjacent relations of attachments that have several rows.

    Both bring all their dates along and count where they meet on the first date that they share, so no pairs are grouped.
    """
    whole = rows.groupBy("attachment_id").agg(F.collect_list(F.struct("message_date", "sender_id")).alias("rows"))
    said = whole.select("*", F.explode(F.array_distinct("rows.message_date")).alias("message_date"))
    reached = near.join(said.select("message_date").distinct(), "message_date", "left_semi")
    days = reached.groupBy("asset_id").agg(F.collect_list(F.struct("message_date", "has_previous", "has_next", "copies", "sources", "has_sent", "has_not_sent")).alias("days"))
    said, dealt = _dealt(said, days.select("*", F.explode("days.message_date").alias("message_date")), blocks, tasks)
    met = dealt.join(said.hint("merge"), ["message_date", "block"]).where(F.col("message_date") == F.array_min(F.array_intersect("days.message_date", "rows.message_date")))
    day_of = lambda r: F.get(F.filter("days", lambda d: d["message_date"] == r["message_date"]), 0)
    hits = F.filter(F.transform("rows", lambda r: F.struct(r["sender_id"].alias("sender_id"), day_of(r).alias("day"))), lambda h: h["day"].isNotNull())
    met = met.select("attachment_id", "asset_id", hits.alias("hits"))
    any_day = lambda field: F.exists("hits", lambda h: h["day"][field])
    sender = F.array_min(F.transform("hits", lambda h: h["sender_id"]))  # of several, the least that is known
    return met.select(
        "attachment_id", "asset_id", any_day("has_previous").alias("has_previous"), any_day("has_next").alias("has_next"),
        F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["day"]["copies"]).alias("copies"),
        F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["day"]["sources"])))).cast("long").alias("sources"),
        compatibility(direction(sender, local), any_day("has_sent"), any_day("has_not_sent")).alias("compatibility"),
    )


def relation_counts(attachments: DataFrame, files: DataFrame, local: int | None) -> DataFrame:
    """Per attachment: exact candidates in all and by compatibility, without listing them."""
    per_date = evidence_by_asset_date(files).groupBy("file_date", "has_sent", "has_not_sent").agg(F.count("*").alias("assets"))
    a = sound_attachments(attachments)
    joined = a.join(per_date, a["message_date"] == per_date["file_date"], "left")
    state = compatibility(direction(F.col("sender_id"), local), F.col("has_sent"), F.col("has_not_sent"))
    sums = [F.coalesce(F.sum(F.when(state == s, F.col("assets"))), F.lit(0)).alias(s) for s in STATES]
    return joined.groupBy("attachment_id").agg(F.coalesce(F.sum("assets"), F.lit(0)).alias("exact"), *sums, F.first("message_date").alias("message_date"), F.first("sender_id").alias("sender_id"))


def state_counts(counts: DataFrame) -> DataFrame:
    """(state, relations, attachments): an attachment counts in every state that it reaches; states without any are 0."""
    parts = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("n")) for s in STATES])).alias("x")
    return counts.select(parts).select("x.*").groupBy("state").agg(F.sum("n").alias("relations"), F.count(F.when(F.col("n") > 0, 1)).alias("attachments"))


def candidate_bands(counts: DataFrame) -> DataFrame:
    """(measure, band, attachments) for all and for compatible exact candidates, every band there."""
    both = counts.select(F.explode(F.array(F.struct(F.lit("exact").alias("measure"), F.col("exact").alias("n")), F.struct(F.lit("compatible").alias("measure"), F.col("Compatible").alias("n")))).alias("x")).select("x.*")
    found = both.groupBy("measure", band(F.col("n"), CANDIDATE_BANDS).alias("band")).agg(F.count("*").alias("attachments"))
    spark = counts.sparkSession
    every = spark.createDataFrame([(m, b) for m in ("exact", "compatible") for b, _ in CANDIDATE_BANDS], "measure string, band string")
    return every.join(found, ["measure", "band"], "left").select("measure", "band", F.coalesce("attachments", F.lit(0)).alias("attachments"))


def source_contributions(attachments: DataFrame, files: DataFrame) -> DataFrame:
    """Per source: its files, and the exact relations that a copy of it supports."""
    per_date = sound_files(files).where("file_date is not null and size > 0").groupBy("source_id", "file_date").agg(F.countDistinct("asset_id").alias("assets"))
    messages = sound_attachments(attachments).groupBy(F.col("message_date").alias("file_date")).agg(F.count("*").alias("messages"))
    credited = per_date.join(messages, "file_date").groupBy("source_id").agg(F.sum(F.col("assets") * F.col("messages")).alias("relations"))
    return source_facts(files).join(credited, "source_id", "left").withColumn("relations", F.coalesce("relations", F.lit(0)))


def relations_by_media_type(attachments: DataFrame, files: DataFrame) -> DataFrame:
    per_date = evidence_by_asset_date(files).groupBy("file_date", "media_type").agg(F.count("*").alias("assets"))
    messages = sound_attachments(attachments).groupBy(F.col("message_date").alias("file_date")).agg(F.count("*").alias("messages"))
    return per_date.join(messages, "file_date").groupBy("media_type").agg(F.sum(F.col("assets") * F.col("messages")).alias("relations"))


def match_census(attachments: DataFrame, files: DataFrame, local: int | None) -> DataFrame:
    """One row with the figures of the whole analysis."""
    counts = relation_counts(attachments, files, local)
    days = evidence_by_asset_date(files).select("asset_id", "file_date")
    dates = attachments.select("message_date").distinct()
    near = dates.select("message_date", F.explode(F.concat(F.array("message_date"), neighbours(F.col("message_date")))).alias("file_date"))
    reached = near.join(days, "file_date")
    # an asset of a neighbouring day only counts where the day itself doesn't have it, and then it counts there anyway
    candidates = reached.agg(F.countDistinct("asset_id").alias("candidate_assets"))
    outside = reached.where("file_date <> message_date").select("message_date", "asset_id").distinct()
    outside = outside.join(days.select(F.col("file_date").alias("message_date"), "asset_id"), ["message_date", "asset_id"], "left_anti").select("message_date").distinct().withColumn("has_adjacent", F.lit(True))
    c = counts.join(outside, "message_date", "left")
    figures = c.agg(
        F.count("*").alias("attachments"),
        F.count(F.when(F.col("sender_id").isNull(), 1)).alias("without_sender"),
        F.countDistinct("message_date").alias("dates"),
        F.count(F.when(F.col("exact") == 0, 1)).alias("without_exact"),
        F.count(F.when(F.col("exact") == 1, 1)).alias("unique_exact"),
        F.count(F.when(F.col("Compatible") == 1, 1)).alias("unique_compatible"),
        F.count(F.when((F.col("exact") == 0) & F.col("has_adjacent"), 1)).alias("adjacent_only"),
    )
    totals = files.agg(F.count("file_date").alias("dated_files"), (F.count("*") - F.count("file_date")).alias("undated_files"))
    one = figures
    for part in (candidates, totals, undated_pools(files), date_density(files).toDF("density_dates", "density_least", "density_lower_median", "density_most")):
        one = one.crossJoin(part)  # of one row each
    return one


def unresolved_scope(linked: DataFrame, messages: DataFrame, files: DataFrame, conversation_id: int) -> DataFrame:
    """One row: unresolved attachments of the conversation, of all, and of others; those without a sender; dates of the
    conversation's messages and of its attachments; and attachments on dates without eligible media."""
    rows = unresolved(linked, messages).withColumn("day", F.to_date("message_time"))
    media = files.where("file_date is not null and size > 0").select(F.col("file_date").alias("day")).distinct().withColumn("has_media", F.lit(True))
    own = F.col("conversation_id") == conversation_id
    counts = rows.join(media, "day", "left").agg(
        F.count(F.when(own, 1)).alias("in_conversation"), F.count("*").alias("in_workspace"), F.count(F.when(~own, 1)).alias("elsewhere"), F.count(F.when(own & F.col("sender_id").isNull(), 1)).alias("without_sender"),
        F.countDistinct(F.when(own, F.col("day"))).alias("attachment_dates"), F.count(F.when(own & F.col("has_media").isNull(), 1)).alias("on_dates_without_media"),
    )
    return counts.crossJoin(messages.where(own).agg(F.countDistinct(F.to_date("message_time")).alias("conversation_dates")))  # of one row each
