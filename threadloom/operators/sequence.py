"""Does message order agree with token order? Censuses across and within directions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.combinatorics import binomial, sign_test, weighted_assignments
from threadloom.functions.names import ASSIGNMENT_BANDS, CANDIDATE_BANDS, SHORTFALL_BANDS, SLACK_BANDS, band
from threadloom.operators.evidence import evidence_by_asset_date
from threadloom.operators.matching import direction, known_direction
from threadloom.operators.scope import token_rows
from threadloom.operators.sound import sound_attachments, sound_files


def _agrees(direction: Column, is_sent: Column) -> Column:
    return F.coalesce((direction == "Outgoing") == is_sent, F.lit(False))


def compatible_assets(files: DataFrame) -> DataFrame:
    """(message_date, direction, asset_id): assets that agree with one direction only on a date, found from the date's
    evidence, without meeting any message."""
    e = evidence_by_asset_date(files)
    side = F.when(F.col("has_sent") & ~F.col("has_not_sent"), "Outgoing").when(F.col("has_not_sent") & ~F.col("has_sent"), "Incoming")
    return e.select(F.col("file_date").alias("message_date"), side.alias("direction"), "asset_id").where("direction is not null")


def cohort_groups(attachments: DataFrame, files: DataFrame, local: int) -> DataFrame:
    """(date, direction) groups of attachments with exactly one compatible exact candidate, and the tokens of its copies.

    Candidates depend on date and direction alone, so a group has one asset, ``asset_id`` and ``last_asset_id``.
    ``tokens`` and ``agreeing_tokens`` (on copies that record the direction) are ascending.
    """
    sides = sound_attachments(attachments).withColumn("direction", direction(F.col("sender_id"), local)).groupBy("message_date", "direction").agg(F.count("*").alias("relations"), F.min("sequence_number").alias("first_sequence"))
    one = compatible_assets(files).groupBy("message_date", "direction").agg(F.count("*").alias("n"), F.min("asset_id").alias("asset_id"), F.max("asset_id").alias("last_asset_id")).where("n = 1").drop("n")
    groups = sides.join(one, ["message_date", "direction"])
    t = token_rows(files).select("asset_id", F.col("file_date").alias("message_date"), "token", "is_sent")
    found = groups.join(t, ["asset_id", "message_date"], "left")
    agreeing = F.when(_agrees(F.col("direction"), F.col("is_sent")), F.col("token"))
    return found.groupBy("message_date", "direction", "relations", "first_sequence", "asset_id", "last_asset_id").agg(F.sort_array(F.collect_set("token")).alias("tokens"), F.sort_array(F.collect_set(agreeing)).alias("agreeing_tokens"))


def strict_order(groups: DataFrame) -> DataFrame:
    """A row for each date with one relation in either direction: its verdict, tokens, distance and provenance."""
    single = groups.where("relations = 1").select("message_date", "direction", "first_sequence", "tokens", "agreeing_tokens")
    out = single.where("direction = 'Outgoing'").drop("direction").toDF("message_date", "o_seq", "o_tokens", "o_agreeing")
    inc = single.where("direction = 'Incoming'").drop("direction").toDF("message_date", "i_seq", "i_tokens", "i_agreeing")
    both = out.join(inc, "message_date")
    o, i = F.get("o_tokens", 0), F.get("i_tokens", 0)
    first, second = F.when(F.col("o_seq") < F.col("i_seq"), o).otherwise(i), F.when(F.col("o_seq") < F.col("i_seq"), i).otherwise(o)
    verdict = (
        F.when((F.size("o_tokens") == 0) | (F.size("i_tokens") == 0), "NoToken")
        .when((F.size("o_tokens") > 1) | (F.size("i_tokens") > 1), "SeveralTokens")
        .when(o == i, "EqualTokens")
        .when(first < second, "Concordant")
        .otherwise("Discordant")
    )
    ordered = verdict.isin("Concordant", "Discordant")
    return both.select("message_date", verdict.alias("verdict"), F.when(ordered, F.abs(first - second)).alias("distance"), F.when(ordered, F.array_contains("o_agreeing", o) & F.array_contains("i_agreeing", i)).alias("both_agreeing"))


@F.pandas_udf(T.StructType([T.StructField("numerator", T.StringType()), T.StructField("exponent", T.LongType()), T.StructField("probability", T.StringType())]))
def _sign_test(observations: pd.Series, concordant: pd.Series) -> pd.DataFrame:
    found = [sign_test(int(n), int(k)) for n, k in zip(observations, concordant, strict=True)]
    return pd.DataFrame([(str(t[0]), t[1], t[2]) if t else (None, None, None) for t in found], columns=["numerator", "exponent", "probability"]).astype({"exponent": "Int64"})


@F.pandas_udf(T.StructType([T.StructField("weighted", T.StringType()), T.StructField("unweighted", T.StringType())]))
def _assignments(sizes: pd.Series, picks: pd.Series) -> pd.DataFrame:
    rows = [(str(weighted_assignments([int(x) for x in s], int(n))), str(binomial(len(s), int(n)))) for s, n in zip(sizes, picks, strict=True)]
    return pd.DataFrame(rows, columns=["weighted", "unweighted"])


def order_summary(observations: DataFrame) -> DataFrame:
    """(sample, observations, concordant, numerator, exponent, probability): the sign test, strict and with agreeing tokens only."""
    kept = observations.where("distance is not null")
    samples = kept.select(F.explode(F.when(F.col("both_agreeing"), F.array(F.lit("strict"), F.lit("agreeing"))).otherwise(F.array(F.lit("strict")))).alias("sample"), "verdict")
    n = samples.groupBy("sample").agg(F.count("*").alias("observations"), F.count(F.when(F.col("verdict") == "Concordant", 1)).alias("concordant"))
    every = observations.sparkSession.createDataFrame([("strict",), ("agreeing",)], "sample string")
    n = every.join(n, "sample", "left").na.fill(0)

    return n.withColumn("t", _sign_test("observations", "concordant")).select("sample", "observations", "concordant", "t.numerator", "t.exponent", "t.probability")


def displacement_bands(observations: DataFrame) -> DataFrame:
    kept = observations.where("distance is not null")
    return kept.groupBy("verdict", band(F.col("distance"), CANDIDATE_BANDS).alias("band")).agg(F.count("*").alias("dates"))


def token_provenance(groups: DataFrame) -> DataFrame:
    """Per direction and kind of token evidence: groups and relations."""
    kind = F.when(F.size("tokens") == 0, "NoToken").when(F.size("agreeing_tokens") == 0, "UnknownOnly").when(F.size("agreeing_tokens") == F.size("tokens"), "AgreeingOnly").otherwise("Both")
    return groups.groupBy("direction", kind.alias("provenance")).agg(F.count("*").alias("groups"), F.sum("relations").alias("relations"))


def namespaces(files: DataFrame) -> DataFrame:
    """Per date on which both directions have tokens: how their ranges lie, shared tokens, and changes of direction
    along the tokens. A token of both directions breaks the chain: neither side of it is a change.

    Only copies with a direction and content are looked at; a date has 10,000 tokens at most.
    """
    t = token_rows(files).where("is_sent is not null and size > 0").groupBy("file_date", "token").agg(F.bool_or("is_sent").alias("o"), F.bool_or(~F.col("is_sent")).alias("i"))
    kind = F.when(F.col("o") & F.col("i"), F.lit(None)).otherwise(F.when(F.col("o"), "O").otherwise("I"))
    before = F.lag(kind).over(Window.partitionBy("file_date").orderBy("token"))
    t = t.withColumn("change", F.when(kind.isNotNull() & before.isNotNull() & (kind != before), 1).otherwise(0))
    d = t.groupBy("file_date").agg(
        F.count(F.when(F.col("o"), 1)).alias("o_tokens"), F.count(F.when(F.col("i"), 1)).alias("i_tokens"), F.count(F.when(F.col("o") & F.col("i"), 1)).alias("shared"), F.sum("change").alias("transitions"),
        F.min(F.when(F.col("o"), F.col("token"))).alias("o_lo"), F.max(F.when(F.col("o"), F.col("token"))).alias("o_hi"), F.min(F.when(F.col("i"), F.col("token"))).alias("i_lo"), F.max(F.when(F.col("i"), F.col("token"))).alias("i_hi"),
    ).where("o_tokens > 0 and i_tokens > 0")
    ranges = F.when((F.col("o_tokens") == 1) | (F.col("i_tokens") == 1), "SingletonInvolved").when(F.col("o_hi") < F.col("i_lo"), "OutgoingBelow").when(F.col("i_hi") < F.col("o_lo"), "IncomingBelow").otherwise("Overlapping")
    return d.select("file_date", "o_tokens", "i_tokens", "shared", "transitions", ranges.alias("ranges"))


def assignment_groups(attachments: DataFrame, files: DataFrame, local: int, agreeing_only: bool = False) -> DataFrame:
    """(date, direction) groups of attachments with exact candidates: messages, compatible assets, token positions and
    whether an order-preserving assignment exists.

    ``seats`` has the compatible assets at each position, by ascending token. Attachments without a sender are an error.
    Messages come from dates with evidence, assets from that evidence; no pair of a message and an asset is made.
    """
    dates = sound_files(files).where("file_date is not null and size > 0").select(F.col("file_date").alias("message_date")).distinct()
    sides = sound_attachments(attachments).withColumn("direction", known_direction(F.col("sender_id"), local))
    messages = sides.join(dates, "message_date", "left_semi").groupBy("message_date", "direction").agg(F.count("*").alias("messages"))
    assets = compatible_assets(files).join(messages, ["message_date", "direction"], "left_semi")
    t = token_rows(files).select("asset_id", F.col("file_date").alias("message_date"), "token", "is_sent")
    held = assets.join(t, ["asset_id", "message_date"])
    if agreeing_only:
        held = held.where(_agrees(F.col("direction"), F.col("is_sent")))
    positions = held.groupBy("message_date", "direction", "token").agg(F.sort_array(F.collect_set("asset_id")).alias("at"))
    seats = positions.groupBy("message_date", "direction").agg(F.count("*").alias("positions"), F.array_sort(F.collect_list(F.struct("token", "at"))).alias("seats"))
    own = assets.groupBy("message_date", "direction").agg(F.count("*").alias("assets"))
    g = messages.join(own, ["message_date", "direction"], "left").join(seats, ["message_date", "direction"], "left")
    g = g.withColumn("assets", F.coalesce("assets", F.lit(0))).withColumn("positions", F.coalesce("positions", F.lit(0)))
    state = F.when(F.col("assets") == 0, "NoCompatibleAsset").when(F.col("positions") == 0, "NoSupportedTokenPosition").when(F.col("positions") < F.col("messages"), "TooFewPositions").otherwise("Feasible")
    seats_ = F.coalesce(F.transform("seats", lambda s: s["at"]), F.array().cast("array<array<bigint>>"))
    return g.select("message_date", "direction", "messages", "assets", "positions", state.alias("state"), F.when(state == "Feasible", F.col("positions") - F.col("messages")).alias("slack"), seats_.alias("seats"))


def sliding_unions(groups: DataFrame) -> DataFrame:
    """Per feasible group and rank of a message: the assets it may have in some order-preserving assignment, how that
    narrows what its direction alone allows, and whether a position in its range holds several assets.

    A sweep along the ranks: with slack s an asset at position p may go to the ranks from p - s to p. Of an asset's
    positions each adds the ranks that the one before didn't reach, so every rank is entered and left once.
    """
    feasible = groups.where("state = 'Feasible'")
    own = ["message_date", "direction", "messages", "assets", "slack"]
    places = feasible.select(*own, F.posexplode("seats").alias("at", "seat")).withColumn("at", F.col("at") + 1)
    one = places.select(*own, "at", F.explode("seat").alias("asset_id"))
    heavy = places.where(F.size("seat") > 1).select(*own, "at", F.lit(None).cast("long").alias("asset_id"))
    last = F.least(F.col("messages"), F.col("at")).cast("long")
    reached = F.lag(last).over(Window.partitionBy("message_date", "direction", "asset_id").orderBy("at"))
    first = F.greatest(F.lit(1).cast("long"), F.col("at") - F.col("slack"), F.coalesce(reached + 1, F.lit(1).cast("long")))
    spans = one.union(heavy).withColumns({"first": first, "last": last}).where("first <= last")
    steps = F.explode(F.array(F.struct(F.col("first").alias("rank"), F.lit(1).alias("by")), F.struct((F.col("last") + 1).alias("rank"), F.lit(-1).alias("by")))).alias("step")
    events = spans.select(*own, "asset_id", steps).where("step.rank <= messages")
    events = events.groupBy(*own, F.col("step.rank").alias("rank")).agg(
        F.sum(F.when(F.col("asset_id").isNotNull(), F.col("step.by")).otherwise(0)).alias("by"), F.sum(F.when(F.col("asset_id").isNull(), F.col("step.by")).otherwise(0)).alias("heavy_by")
    )
    along = Window.partitionBy("message_date", "direction").orderBy("rank")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    stretches = events.select(*own, "rank", F.coalesce(F.lead("rank").over(along) - 1, F.col("messages")).alias("until"), F.sum("by").over(upto).alias("n"), (F.sum("heavy_by").over(upto) > 0).alias("heavy"))
    narrowing = F.when(F.col("n") == F.col("assets"), "NoReduction").when(F.col("n") == 1, "Unique").otherwise("Reduced")
    ranks = stretches.withColumn("rank", F.explode(F.sequence("rank", "until")))
    return ranks.select("message_date", "direction", F.col("rank").cast("int").alias("rank"), "assets", F.col("n").cast("long").alias("possible_assets"), narrowing.alias("narrowing"), "heavy")


def narrowing_summary(unions: DataFrame) -> DataFrame:
    """(direction or null for both, ...): messages by narrowing, those that had one asset anyway, and relations before and after."""
    sides = unions.select("*", F.explode(F.array(F.col("direction"), F.lit(None).cast("string"))).alias("side"))
    kinds = [F.count(F.when(F.col("narrowing") == k, 1)).alias(k) for k in ("NoReduction", "Unique", "Reduced")]
    already = F.count(F.when((F.col("narrowing") == "NoReduction") & (F.col("assets") == 1), 1)).alias("already_unique")
    return sides.groupBy(F.col("side").alias("direction")).agg(*kinds, already, F.sum("assets").alias("baseline_relations"), F.sum("possible_assets").alias("sequence_relations"), F.count(F.when(F.col("heavy"), 1)).alias("range_holds_heavy"))


def _both_sides(groups: DataFrame) -> DataFrame:
    """Each group under its direction, and under null for both together."""
    return groups.select(*[c for c in groups.columns if c != "direction"], F.explode(F.array(F.col("direction"), F.lit(None).cast("string"))).alias("direction"))


def assignment_bands(groups: DataFrame) -> DataFrame:
    """(direction or null for both, measure, band, groups): groups by assets, positions and asset places."""
    places = F.aggregate("seats", F.lit(0).cast("long"), lambda n, s: n + F.size(s))
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("n")) for m, v in (("assets", F.col("assets")), ("positions", F.col("positions")), ("occurrences", places))])).alias("x")
    rows = _both_sides(groups).select("direction", values).select("direction", "x.*")
    return rows.groupBy("direction", "measure", band(F.col("n"), CANDIDATE_BANDS).alias("band")).agg(F.count("*").alias("groups"))


def feasibility(groups: DataFrame) -> DataFrame:
    """(direction or null for both, state, groups, messages, relations): a message and each compatible asset of its group are one relation."""
    rows = _both_sides(groups)
    return rows.groupBy("direction", "state").agg(F.count("*").alias("groups"), F.sum("messages").alias("messages"), F.sum(F.col("messages") * F.col("assets")).alias("relations"))


def slack_bands(groups: DataFrame) -> DataFrame:
    """(direction or null for both, band, groups, messages): positions less messages, also where they are too few."""
    rows = _both_sides(groups)
    return rows.groupBy("direction", band(F.col("positions") - F.col("messages"), SLACK_BANDS).alias("band")).agg(F.count("*").alias("groups"), F.sum("messages").alias("messages"))


def shortfall_bands(groups: DataFrame) -> DataFrame:
    """(direction or null for both, band, groups): by how many positions the groups with too few fall short."""
    rows = _both_sides(groups).where("state = 'TooFewPositions'")
    return rows.groupBy("direction", band(F.col("messages") - F.col("positions"), SHORTFALL_BANDS).alias("band")).agg(F.count("*").alias("groups"))


def multiplicity(groups: DataFrame) -> DataFrame:
    """Per direction (null for both), infeasible groups included: assets at one position and at several, the most positions
    of one asset, and positions with several assets."""
    rows = groups.select("message_date", "direction", F.posexplode("seats").alias("at", "seat"))
    assets = rows.select("message_date", "direction", F.explode("seat").alias("asset_id")).groupBy("message_date", "direction", "asset_id").agg(F.count("*").alias("n"))
    per = _both_sides(assets).groupBy("direction").agg(F.count(F.when(F.col("n") == 1, 1)).alias("assets_at_one"), F.count(F.when(F.col("n") > 1, 1)).alias("assets_at_several"), F.max("n").alias("most_positions"))
    heavy = rows.where(F.size("seat") > 1).groupBy("message_date", "direction").agg(F.count("*").alias("n"))
    heavy = _both_sides(heavy).groupBy("direction").agg(F.sum("n").alias("heavy_positions"), F.count("*").alias("groups_with_heavy"))
    return per.join(heavy, per["direction"].eqNullSafe(heavy["direction"]), "left").select(per["*"], F.coalesce("heavy_positions", F.lit(0)).alias("heavy_positions"), F.coalesce("groups_with_heavy", F.lit(0)).alias("groups_with_heavy"))


def forced_assignments(groups: DataFrame) -> DataFrame:
    """Per direction (null for both): groups without slack, their messages, and those whose place holds one asset or several."""
    rows = _both_sides(groups.where("state = 'Feasible' and slack = 0"))
    several = F.size(F.filter("seats", lambda s: F.size(s) > 1))
    return rows.groupBy("direction").agg(F.count("*").alias("groups"), F.sum("messages").alias("messages"), F.sum(F.size("seats") - several).alias("one_asset"), F.sum(several).alias("several_assets"))


def agreeing_loss(groups: DataFrame, agreeing: DataFrame) -> DataFrame:
    """Per direction: what is lost if only copies that record the direction count: positions, and assets that lose all."""
    n = F.size(F.array_distinct(F.flatten("seats"))).cast("long")
    a = groups.select("message_date", "direction", "positions", n.alias("seated"), (F.col("messages") * F.col("assets")).alias("relations"), "messages")
    b = agreeing.select("message_date", "direction", F.col("positions").alias("positions_left"), n.alias("seated_left"))
    return a.join(b, ["message_date", "direction"]).groupBy("direction").agg(
        F.sum(F.col("positions") - F.col("positions_left")).alias("positions_removed"), F.sum(F.col("seated") - F.col("seated_left")).alias("assets_losing_all"), F.sum("relations").alias("frozen_relations"), F.sum(F.col("messages") * F.col("seated_left")).alias("agreeing_relations")
    )


def excluded_attachments(attachments: DataFrame, files: DataFrame) -> DataFrame:
    """One row: attachments on dates without evidence, which no group has."""
    dates = sound_files(files).where("file_date is not null and size > 0").select(F.col("file_date").alias("message_date")).distinct()
    return sound_attachments(attachments).join(dates, "message_date", "left_anti").agg(F.count("*").alias("attachments"), F.countDistinct("message_date").alias("dates"))


def assignment_counts(groups: DataFrame) -> DataFrame:
    """Per feasible group: how many order-preserving assignments there are, as exact decimal strings, and their band."""
    sizes = F.transform("seats", lambda s: F.size(s))
    feasible = groups.where("state = 'Feasible'").withColumn("n", _assignments(sizes, "messages"))
    digits = F.length("n.weighted")
    number = F.when(digits <= 18, F.col("n.weighted").cast("long")).otherwise(F.lit(10**18))  # beyond every band
    return feasible.select("message_date", "direction", "messages", "positions", "n.weighted", "n.unweighted", band(number, ASSIGNMENT_BANDS).alias("band"))
