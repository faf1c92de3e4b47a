"""How informative is a direction sequence? Message patterns against labelled token positions, per scope and date."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import combinatorics as exact
from threadloom.functions.ordered import number_rows
from threadloom.operators.matching import known_direction
from threadloom.operators.scope import token_rows
from threadloom.operators.summaries import count_summary, counted, difference_summary, ratio_summary
from threadloom.session import materialize
from threadloom.operators.sound import sound_attachments

#: The scopes, in order, with what their key is.
SCOPES = (("SourceDate", "source_id"), ("DeviceGroupDate", "group_id"))


#: The kinds of degenerate pairs.
DEGENERATE = ("no_tokens", "single_symbol", "no_outgoing", "no_incoming", "single_arrangement")


def message_patterns(attachments: DataFrame, local: int) -> DataFrame:
    """(message_date, pattern): the day's directions in order, as a string of O and I.

    An attachment without a sender is an error here: nothing is said about an archive that has one.
    """
    side = F.when(known_direction(F.col("sender_id"), local) == "Outgoing", "O").otherwise("I")
    rows = sound_attachments(attachments).select("message_date", F.struct("sequence_number", "attachment_id", side.alias("s")).alias("x"))
    return rows.groupBy("message_date").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "").alias("pattern"))


def logical_positions(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Per scope, key, date and token: copies by direction, and what the position says."""
    rows = token_rows(files, groups)
    keys = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.col(c).cast("long").alias("scope_key")) for s, c in SCOPES])).alias("k")
    copies = rows.select("file_date", "token", "is_sent", keys).select("k.*", "file_date", "token", "is_sent").groupBy("scope", "scope_key", "file_date", "token").agg(F.count(F.when(F.col("is_sent"), 1)).alias("sent"), F.count(F.when(~F.col("is_sent"), 1)).alias("not_sent"), F.count(F.when(F.col("is_sent").isNull(), 1)).alias("unknown"))
    label = F.when((F.col("sent") > 0) & (F.col("not_sent") > 0), "Conflict").when(F.col("sent") > 0, "O").when(F.col("not_sent") > 0, "I").otherwise("Unlabelled")
    return copies.withColumn("label", label)


def pairs(attachments: DataFrame, files: DataFrame, groups: DataFrame, local: int) -> DataFrame:
    """A row for each scope, key and date with messages or tokens: its two sequences, supply and state.

    ``token_pattern`` has the labelled positions in order of token, at most 10,000 of them.
    """
    pos = logical_positions(files, groups)
    labelled = F.col("label").isin("O", "I")
    shapes = pos.groupBy("scope", "scope_key", "file_date").agg(
        F.count(F.when(F.col("label") == "Conflict", 1)).alias("conflicts"), F.count(F.when(F.col("label") == "Unlabelled", 1)).alias("unlabelled"), F.sum("sent").alias("sent_copies"), F.sum("not_sent").alias("not_sent_copies"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(labelled, F.struct("token", "label")))), lambda x: x["label"]), "").alias("token_pattern"),
    )
    sources = files.select("source_id").distinct().join(F.broadcast(groups), "source_id")
    keys = sources.select(F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.col(c).cast("long").alias("scope_key")) for s, c in SCOPES])).alias("k")).select("k.*").distinct()
    messages = message_patterns(attachments, local)
    every = keys.crossJoin(messages.select(F.col("message_date").alias("file_date"))).union(shapes.select("scope", "scope_key", "file_date")).distinct()  # keys are sources and groups
    p = every.join(shapes, ["scope", "scope_key", "file_date"], "left").join(messages.withColumnRenamed("message_date", "file_date"), "file_date", "left")
    p = p.na.fill(0, ["conflicts", "unlabelled", "sent_copies", "not_sent_copies"]).na.fill("", ["token_pattern", "pattern"])
    count = lambda c, x: F.length(F.translate(c, "I" if x == "O" else "O", "")).cast("long")
    p = p.withColumns({"m_out": count("pattern", "O"), "m_in": count("pattern", "I"), "t_out": count("token_pattern", "O"), "t_in": count("token_pattern", "I")})
    tokens = F.col("t_out") + F.col("t_in")
    enough = (F.col("t_out") >= F.col("m_out")) & (F.col("t_in") >= F.col("m_in"))
    runs = F.size(F.regexp_extract_all("token_pattern", F.lit("(O+|I+)"), 1))
    p = p.withColumn("token_runs", runs.cast("long"))
    # one arrangement alone has these numbers of letters and runs: letters of one kind, or strict alternation that
    # begins and ends with the commoner kind
    one_arrangement = (F.col("t_out") == 0) | (F.col("t_in") == 0) | ((F.col("token_runs") == tokens) & (F.col("t_out") != F.col("t_in")))
    kinds = {
        "no_tokens": tokens == 0, "single_symbol": F.length("pattern") == 1, "no_outgoing": (tokens > 0) & (F.col("t_out") == 0),
        "no_incoming": (tokens > 0) & (F.col("t_in") == 0), "single_arrangement": (tokens > 0) & one_arrangement,
    }
    p = p.withColumns(kinds)
    degenerate = F.greatest(*[F.col(k) for k in DEGENERATE])
    state = (
        F.when(F.col("pattern") == "", "NoMessageSymbols")
        .when(F.col("conflicts") > 0, "ExcludedByDirectionConflict")
        .when(tokens == 0, "NoTokenPositions")
        .when(~enough, "SupplyInsufficient")
        .when(degenerate, "Degenerate")
        .otherwise("Classified")
    )
    before = (F.col("sent_copies") >= F.col("m_out")) & (F.col("not_sent_copies") >= F.col("m_in"))
    return p.withColumns({"supply_copies": before, "supply_positions": enough, "state": state})


def pair_states(found: DataFrame) -> DataFrame:
    return found.groupBy("scope", "state").agg(F.count("*").alias("pairs"), F.sum(F.length("pattern")).cast("long").alias("message_symbols"))


def _measured(found: DataFrame) -> DataFrame:
    """Pairs with messages and without conflict."""
    return found.where("pattern <> '' and conflicts = 0").withColumn("symbols", F.length("pattern").cast("long"))


def degenerate_kinds(found: DataFrame) -> DataFrame:
    """Per scope: pairs of each degenerate kind (one pair can be of several), of any, and the messages of those."""
    some = F.greatest(*[F.col(k) for k in DEGENERATE])
    return _measured(found).groupBy("scope").agg(*[counted(F.col(k)).alias(k) for k in DEGENERATE], counted(some).alias("degenerate"), F.coalesce(F.sum(F.when(some, F.col("symbols"))), F.lit(0)).alias("message_symbols"))


def dilution(found: DataFrame) -> DataFrame:
    """Per scope, over measured pairs with tokens: the spread of message symbols and of token positions."""
    rows = _measured(found).where(~F.col("no_tokens"))
    values = F.explode(F.array(F.struct(F.lit("message_symbols").alias("measure"), F.col("symbols").alias("n")), F.struct(F.lit("token_positions").alias("measure"), (F.col("t_out") + F.col("t_in")).alias("n")))).alias("x")
    return count_summary(rows.select("scope", values).select("scope", "x.*"), ["scope", "measure"], "n")


def conversation_share(found: DataFrame) -> DataFrame:
    """Per scope, over measured pairs with tokens: message symbols as a share of token positions."""
    rows = _measured(found).where(~F.col("no_tokens")).select("scope", "symbols", (F.col("t_out") + F.col("t_in")).alias("tokens"))
    return ratio_summary(rows, ["scope"], "symbols", "tokens")


def shortfalls(found: DataFrame) -> DataFrame:
    """Per scope, over measured pairs: how many messages lack a copy, and a position once copies are collapsed; and the
    pairs that collapsing makes insufficient or sufficient."""
    lacks = lambda have, want: F.greatest(F.lit(0), F.col(want) - F.col(have))
    rows = _measured(found).select(
        "scope", "symbols", lacks("sent_copies", "m_out").alias("bo"), lacks("not_sent_copies", "m_in").alias("bi"), lacks("t_out", "m_out").alias("ao"), lacks("t_in", "m_in").alias("ai"), "supply_copies", "supply_positions"
    )
    lost = F.col("supply_copies") & ~F.col("supply_positions")
    return rows.groupBy("scope").agg(
        F.count("*").alias("pairs"), F.sum("bo").alias("outgoing_before"), F.sum("bi").alias("incoming_before"), F.sum("ao").alias("outgoing_after"), F.sum("ai").alias("incoming_after"),
        counted(lost).alias("become_insufficient"), counted(~F.col("supply_copies") & F.col("supply_positions")).alias("become_sufficient"), F.coalesce(F.sum(F.when(lost, F.col("symbols"))), F.lit(0)).alias("symbols_lost"),
    )


def shortfall_differences(found: DataFrame) -> DataFrame:
    """Per scope, over measured pairs: the spread of token positions less message symbols."""
    rows = _measured(found).select("scope", (F.col("t_out") + F.col("t_in") - F.col("symbols")).alias("surplus"))
    return difference_summary(rows, ["scope"], "surplus")


def message_population(patterns: DataFrame) -> DataFrame:
    """(measure, value, dates): distributions of the day patterns' lengths, runs, transitions and directions."""
    runs = F.size(F.regexp_extract_all("pattern", F.lit("(O+|I+)"), 1)).cast("long")
    sides = F.when(~F.contains("pattern", F.lit("I")), "OutgoingOnly").when(~F.contains("pattern", F.lit("O")), "IncomingOnly").otherwise("Both")
    named = {"length": F.length("pattern").cast("string"), "runs": runs.cast("string"), "transitions": (runs - 1).cast("string"), "directions": sides}
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in named.items()])).alias("x")
    return patterns.select(values).select("x.*").groupBy("measure", "value").agg(F.count("*").alias("dates"))


def multi_attachments(messages: DataFrame, linked: DataFrame) -> DataFrame:
    """One row: messages, those without an attachment, those with several, and the most on one; ``messages`` has message_id,
    ``linked`` a row (message_id) for each attachment."""
    per = linked.groupBy("message_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return messages.select("message_id").join(per, "message_id", "left").agg(
        F.count("*").alias("messages"), counted(n == 0).alias("without"), counted(n > 1).alias("with_several"), F.coalesce(F.max(n), F.lit(0)).alias("most")
    )


def source_populations(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Per source: files, dated ones, those with a token, those of them with a direction, and its positions by label,
    those that another source has as well among them."""
    rows = token_rows(files, groups)
    facts = files.groupBy("source_id").agg(F.count("*").alias("files"), F.count("file_date").alias("dated"))
    have = rows.groupBy("source_id").agg(F.count("*").alias("with_token"), F.count("is_sent").alias("with_direction"), F.countDistinct("file_date").alias("dates"), F.min("file_date").alias("first_date"), F.max("file_date").alias("last_date"))
    pos = logical_positions(files, groups).where("scope = 'SourceDate'").withColumnRenamed("scope_key", "source_id")
    n = pos.groupBy("file_date", "token").agg(F.count("*").alias("sources"))
    labels = pos.join(n, ["file_date", "token"]).groupBy("source_id").agg(
        F.count("*").alias("positions"), counted(F.col("label").isin("O", "I")).alias("labelled"), counted(F.col("label") == "Unlabelled").alias("unlabelled"), counted(F.col("label") == "Conflict").alias("conflicting"), counted(F.col("sources") > 1).alias("shared")
    )
    out = facts.join(groups, "source_id", "left").join(have, "source_id", "left").join(labels, "source_id", "left")
    return out.na.fill(0, ["with_token", "with_direction", "dates", "positions", "labelled", "unlabelled", "conflicting", "shared"])


def group_populations(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Per device group: its sources, those without any direction and their token rows, positions by label, and those
    known only from sources without any direction."""
    sources = source_populations(files, groups).where("group_id is not null")
    blind = F.col("with_direction") == 0
    facts = sources.groupBy("group_id").agg(F.count("*").alias("sources"), counted(blind).alias("blind_sources"), F.sum("files").alias("files"), F.sum("with_token").alias("with_token"), F.sum("with_direction").alias("with_direction"), F.coalesce(F.sum(F.when(blind, F.col("with_token"))), F.lit(0)).alias("blind_files"))
    rows = token_rows(files, groups).join(F.broadcast(sources.select("source_id", blind.alias("blind"))), "source_id")  # a row for each source
    per = rows.groupBy("group_id", "file_date", "token").agg(F.bool_or("is_sent").alias("o"), F.bool_or(~F.col("is_sent")).alias("i"), F.bool_and("blind").alias("blind"))
    o, i = F.coalesce("o", F.lit(False)), F.coalesce("i", F.lit(False))
    labels = per.groupBy("group_id").agg(F.countDistinct("file_date").alias("dates"), F.count("*").alias("positions"), counted(o != i).alias("labelled"), counted(~o & ~i).alias("unlabelled"), counted(o & i).alias("conflicting"), counted(F.col("blind")).alias("blind_only"))
    return facts.join(labels, "group_id", "left").na.fill(0)


def cross_source_overlap(files: DataFrame, groups: DataFrame) -> DataFrame:
    """One row over (date, token): those of one source and of several, and how the directions of the latter agree.

    Conflicts are told apart by whether one source or device group already has both directions.
    """
    per = token_rows(files, groups).groupBy("file_date", "token", "source_id", "group_id").agg(F.coalesce(F.bool_or("is_sent"), F.lit(False)).alias("o"), F.coalesce(F.bool_or(~F.col("is_sent")), F.lit(False)).alias("i"))
    both, known = F.col("o") & F.col("i"), F.col("o") | F.col("i")
    at = per.groupBy("file_date", "token").agg(
        F.count("*").alias("n"), counted(known).alias("known"), counted(both).alias("inside"), counted(F.col("o") & ~F.col("i")).alias("out"), counted(F.col("i") & ~F.col("o")).alias("inc"), F.min(F.when(known, F.col("group_id"))).alias("g1"), F.max(F.when(known, F.col("group_id"))).alias("g2")
    )
    shared = F.col("n") > 1
    clash = shared & ((F.col("inside") > 0) | ((F.col("out") > 0) & (F.col("inc") > 0)))
    within = clash & ((F.col("inside") > 0) | (F.col("g1") == F.col("g2")))
    return at.agg(
        F.count("*").alias("positions"), counted(shared).alias("shared"), counted(~shared).alias("single_source"), counted(shared & ~clash & (F.col("known") > 1)).alias("agreeing"), counted(clash).alias("conflicting"),
        counted(shared & ~clash & (F.col("known") == 1)).alias("one_side_known"), counted(shared & (F.col("known") == 0)).alias("none_known"), counted(within).alias("conflicts_within_group"), counted(clash & ~within).alias("conflicts_across_groups"),
    )


def supply(found: DataFrame) -> DataFrame:
    """Per scope, over pairs with messages and without conflict: those whose copies and whose positions suffice."""
    rows = found.where("pattern <> '' and conflicts = 0")
    return rows.groupBy("scope").agg(F.count("*").alias("pairs"), F.count(F.when(F.col("supply_copies"), 1)).alias("enough_copies"), F.count(F.when(F.col("supply_positions"), 1)).alias("enough_positions"))


def numbered(found: DataFrame) -> DataFrame:
    """Pairs with messages, numbered by scope, key and date over all partitions."""
    order = F.when(F.col("scope") == SCOPES[0][0], 0).otherwise(1)
    return number_rows(found.where("pattern <> ''"), [order.asc(), F.asc("scope_key"), F.asc("file_date")], materialize, "pair_id")


_COUNTS = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "s", "p", "q", "exchangeable")] + [T.StructField(c, T.BooleanType()) for c in ("binary_determinate", "graded_determinate")] + [T.StructField("band", T.StringType()), T.StructField("share", T.DoubleType())])


@F.pandas_udf(_COUNTS)
def _reference(pattern: pd.Series, o: pd.Series, i: pd.Series, r: pd.Series) -> pd.DataFrame:
    rows = []
    for p, t_out, t_in, runs in zip(pattern, o.astype(int), i.astype(int), r.astype(int), strict=True):
        o_, i_, r_ = int(t_out), int(t_in), int(runs)
        a, s, pairs, q = exact.arrangement_count(o_, i_, r_), exact.admitting_count(p, o_, i_, r_), exact.embedding_count(p, o_, i_, r_), exact.squared_embedding_count(p, o_, i_, r_)
        binary, graded = s in (0, a), a * q == pairs * pairs
        if not a or a * q < pairs * pairs or (graded and not binary):
            raise ValueError("counts contradict one another")
        share = exact.decimal_reading(pairs, a * exact.binomial(o_ + i_, len(p)))
        rows.append((str(a), str(s), str(pairs), str(q), str(exact.exchangeable_admitting_count(p, o_, i_)), binary, graded, exact.qr_band(s, a), share))
    return pd.DataFrame(rows, columns=_COUNTS.names)


#: What the exact counts of a pair follow from.
SHAPE = ("pattern", "t_out", "t_in", "token_runs")


def reference_counts(found: DataFrame) -> DataFrame:
    """Of each classified pair the exact counts, as decimal strings, what they determine, and how much more often its
    directions change than expected. Counts that contradict one another are an error.

    The counts follow from the pattern and three numbers, which many pairs share, so they are made once for each such shape."""
    rows = materialize(found.where("state = 'Classified'").select("scope", "scope_key", "file_date", *SHAPE), "classified")
    # as many tasks as asked for, however few bytes they read: it is the counting that takes long
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shapes = materialize(rows.select(*SHAPE).distinct().repartition(tasks).withColumn("c", _reference(*SHAPE)), "shapes")
    rows = rows.join(shapes, list(SHAPE))
    transitions = F.size(F.regexp_extract_all("pattern", F.lit("(O+|I+)"), 1)) - 1
    order = F.when(transitions == 0, "NotOrderInformative").when(transitions == 1, "WeaklyOrderInformative").otherwise("StrictlyOrderInformative")
    return rows.select("scope", "scope_key", "file_date", "pattern", "t_out", "t_in", "token_runs", "c.*", (F.col("token_runs") - expected_runs(F.col("t_out"), F.col("t_in"))).alias("burstiness"), order.alias("order_class"))


def expected_runs(o: Column, i: Column) -> Column:
    """How many runs a random arrangement has on the average; 0 without letters."""
    return F.when(o + i > 0, 1 + 2 * o * i / (o + i)).otherwise(F.lit(0.0))


def determinacy(counts: DataFrame) -> DataFrame:
    """Per scope, of ``reference_counts``: pairs by both determinacies, their messages, and order classes."""
    b, g = F.col("binary_determinate"), F.col("graded_determinate")
    n = F.length("pattern").cast("long")
    return counts.groupBy("scope").agg(
        F.count("*").alias("pairs"), counted(b).alias("binary_determinate"), counted(~b).alias("binary_informative"), counted(g).alias("graded_determinate"), counted(~g).alias("graded_informative"), counted(b & ~g).alias("binary_determinate_graded_informative"),
        F.coalesce(F.sum(F.when(~b, n)), F.lit(0)).alias("informative_symbols"), counted(F.col("exchangeable") != "0").alias("exchangeable_possible"), *[counted(F.col("order_class") == c).alias(c) for c in ("NotOrderInformative", "WeaklyOrderInformative", "StrictlyOrderInformative")],
    )


def burstiness_summary(counts: DataFrame) -> DataFrame:
    """Per scope: the spread of burstiness over the pairs of ``reference_counts``."""
    return difference_summary(counts, ["scope"], "burstiness")


def source_overlap(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Per source: dates and (date, token) keys it has, and those that another source has as well."""
    keys = token_rows(files, groups).select("source_id", "file_date", "token").distinct()
    n = keys.groupBy("file_date", "token").agg(F.count("*").alias("sources"))
    return keys.join(n, ["file_date", "token"]).groupBy("source_id").agg(F.countDistinct("file_date").alias("dates"), F.count("*").alias("keys"), F.count(F.when(F.col("sources") > 1, 1)).alias("shared_keys"))
