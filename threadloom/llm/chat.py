"""Chat formatting with cumulative-snapshot collapse.

Logging systems often store a conversation again after each turn, so one conversation is there many times, each
a prefix of the next. A rolling hash over turns names every prefix of every conversation; a conversation whose
whole hash is the hash of a proper prefix elsewhere adds nothing and is removed by an anti-join.

The hash of a prefix is its length with two 64-bit words, each the exclusive or of a hash of every turn with its place.
A window rolls it on from turn to turn, so turns stay rows until the conversations that remain are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.storage import materialize

TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def turns_with_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, h1, h2, last): turns in order from place 1, and the rolling hash after each."""
    rows = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    so_far = Window.partitionBy("conv_id").orderBy(*[F.asc_nulls_first(c) for c in ("turn", "role", "text")]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"place": F.row_number().over(so_far), "n": F.count("*").over(Window.partitionBy("conv_id"))})
    in_order = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def mark(seed: int) -> Column:
        known = [x for c in ("role", "text") for x in (F.col(c).isNull(), F.coalesce(c, F.lit("")))]
        return F.bit_xor(F.xxhash64(F.lit(seed), "place", *known)).over(in_order)

    return rows.select("conv_id", "place", "role", "text", mark(1).alias("h1"), mark(2).alias("h2"), (F.col("place") == F.col("n")).alias("last"))


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the maximal conversations.

    A conversation goes if it is a proper prefix of another one, or equal to one with a smaller conv_id. Turns are
    ordered by (turn, role, text), nulls first; a null role or text differs from an empty one; repeated rows are
    repeated turns; rows without a conv_id belong to no conversation and are left out. Numbers of turns are not
    compared, only their order. Empty input: no rows. Other columns are ignored.
    """
    rows = materialize(turns_with_prefixes(turns), "turns")
    key = ["place", "h1", "h2"]
    first = rows.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    prefixes = rows.where("not last").select(*key).distinct()
    maximal = first.join(prefixes, key, "left_anti").select("conv_id")
    kept = rows.select("conv_id", F.struct("place", "role", "text").alias("turn")).join(maximal, "conv_id", "left_semi")
    return kept.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))


def render_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_chars, rendered): each maximal conversation as one training text.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``; a null role reads ``unknown``, a null text is empty.
    Markers inside a turn's text lose their bars, so that text can't end its own turn.
    """

    def safe(x: Column) -> Column:
        return F.replace(F.replace(x, F.lit(TURN_START), F.lit("<im_start>")), F.lit(TURN_END), F.lit("<im_end>"))

    def one(t: Column) -> Column:
        return F.concat(F.lit(TURN_START), safe(F.coalesce(t["role"], F.lit("unknown"))), F.lit("\n"), safe(F.coalesce(t["text"], F.lit(""))), F.lit(TURN_END + "\n"))

    text = F.array_join(F.transform("turns", one), "")
    out = collapse_snapshots(turns).select("conv_id", F.size("turns").cast("long").alias("n_turns"), text.alias("rendered"))
    return out.select("conv_id", "n_turns", F.length("rendered").cast("long").alias("n_chars"), "rendered")
