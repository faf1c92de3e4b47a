"""Packing of token pieces into sequences by a configuration linear program.

Only the histogram of piece lengths matters for a packing, and it has as many entries as a sequence has tokens, no
matter how many documents there are. A configuration is a multiset of lengths that fits into one sequence. The
program "cover every length as often as it occurs with as few configurations as possible" is solved by
multiplicative weights. A sweep covers the demand once: the weight of a length falls exponentially with the share of it
that is covered, a knapsack dynamic program over all lengths prices the configurations of most weight, and those near
the best are taken. Between sweeps the prices themselves, which the weights start from, are multiplied up for lengths
that took more room than they pay for. Prices over the value of their best configuration are a solution of the dual
program, so each sweep gives a lower bound on the number of sequences, and the sweeps end where that is close enough.

Rounding down leaves a rest of lengths, which is packed best fit. The resulting plan is small; the pieces find their
places in it by their rank among the pieces of their length, which Spark counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.storage import materialize
from threadloom.llm.text import pieces
from threadloom.llm.tokens import PieceEncoder

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END_ID = 2048, 0
#: Sweeps at most, and the gap between sequences and bound at which they end.
SWEEPS, GAP = 4, 0.001
#: How steeply a weight falls with the share of its length that is covered, and how strongly prices are corrected.
STEP, CORRECTION = 0.5, 1.0
#: Configurations of that share of the best one's weight count as best.
NEAR = 0.97
#: Pieces that one task ranks at once.
RANK_ROWS = 500_000


class Plan(NamedTuple):
    """Rows for intervals of ranks: pieces of ``length`` ranked from ``first`` on go to ``count`` sequences from
    ``sequence`` on, ``each`` to a sequence, the first at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    count: np.ndarray
    each: np.ndarray
    offset: np.ndarray


class Packing(NamedTuple):
    """A plan, its number of sequences, and the number below which no packing can be."""

    plan: Plan
    sequences: int
    bound: float


#: A configuration: indices of lengths, ascending, and how often it has each.
Configuration = tuple[np.ndarray, np.ndarray]


def knapsack(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to ``capacity``: the most value of any multiset of ``lengths`` (ascending) that fits, and the
    last length of one that has it (-1: it is that of the room one less)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := fit[room]:
            total = value[:k] + best[room - lengths[:k]]
            top = int(total.argmax())
            if total[top] > best[room]:
                best[room], last[room] = total[top], top
    return best, last


def priced(value: np.ndarray, lengths: np.ndarray, capacity: int, near: float = NEAR) -> tuple[float, list[tuple[float, Configuration]]]:
    """The weight of the best configuration, and for each length the best one that has it, if near that; best first."""
    best, last = knapsack(value, lengths, capacity)
    total = value + best[capacity - lengths]
    starts = np.flatnonzero(total >= near * best[capacity])
    starts = starts[np.argsort(-total[starts], kind="stable")]
    room, own = capacity - lengths[starts], np.arange(len(starts))
    taken = [own * len(lengths) + starts]
    while len(own):
        # down to the room at which the last length was added
        down = last[room] < 0
        room[down] -= 1
        use = ~down & (room > 0)
        taken.append(own[use] * len(lengths) + last[room[use]])
        room[use] -= lengths[last[room[use]]]
        live = room > 0
        own, room = own[live], room[live]
    cells, n = np.unique(np.concatenate(taken), return_counts=True)
    ends = np.searchsorted(cells, np.arange(len(starts) + 1) * len(lengths))
    return float(best[capacity]), [(float(total[s]), (cells[a:b] % len(lengths), n[a:b])) for s, a, b in zip(starts, ends, ends[1:])]


def sweep(price: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[Configuration, float]], float]:
    """(configuration, amount) that cover ``counts`` once, and the dual bound of ``price``.

    A step takes a configuration as often as its scarcest length allows, whole times where that is once at least.
    """
    chosen: dict[bytes, list] = {}
    left, bound = counts.astype(float), 0.0
    while (use := np.flatnonzero(left > 1e-9)).size:
        weight = price[use] * np.exp(-STEP * (1 - left[use] / counts[use]))
        value, found = priced(weight, lengths[use], capacity)
        if not bound:
            bound = float(counts @ price) / value  # nothing is covered yet: the weights are the prices
        stepped = False
        for k, (_, (i, n)) in enumerate(found):
            at = use[i]
            amount = (left[at] / n).min()
            amount = float(np.floor(amount + 1e-9)) if amount >= 1 or stepped or k + 1 < len(found) else float(amount)
            if amount <= 0 or (price[at] * np.exp(-STEP * (1 - left[at] / counts[at]))) @ n < NEAR * value:
                continue
            # not so often that a length falls far behind in weight within one pricing
            amount = min(amount, max(1.0, float(np.floor((counts[at] / n).min() * (1 - NEAR) / STEP))))
            left[at] -= amount * n
            chosen.setdefault(at.tobytes() + n.tobytes(), [(at, n), 0.0])[1] += amount
            stepped = True
        if not stepped:  # less than one of every configuration is left: the best fractions
            i, n = found[0][1]
            amount = float((left[use[i]] / n).min())
            left[use[i]] -= amount * n
            chosen.setdefault(use[i].tobytes() + n.tobytes(), [(use[i], n), 0.0])[1] += amount
    return [(c, x) for c, x in chosen.values()], bound


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[Configuration, float]], float]:
    """(configuration, amount) of the sweep with least configurations in all, and the best dual bound of all sweeps."""
    price = lengths / capacity
    best, fewest, bound = [], np.inf, 0.0
    for _ in range(SWEEPS):
        cover, below = sweep(price, lengths, counts, capacity)
        bound, total = max(bound, below), sum(x for _, x in cover)
        if total < fewest:
            best, fewest = cover, total
        if fewest <= (1 + GAP) * bound:
            break
        # a configuration's room, shared among its lengths by price, over what the lengths pay
        took = np.zeros(len(lengths))
        for (i, n), x in cover:
            took[i] += x * price[i] * n / (price[i] @ n)
        price = price * (took / (counts * price)) ** CORRECTION
    return best, bound


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[np.ndarray, int]]:
    """(configuration, times): decreasing best fit over a histogram; sequences that are equal so far are one group.

    Where a length fits best it goes on fitting best until the room is less than it, so a group takes as many as
    fit into each of its sequences, and at most one group is split for each length.
    """
    groups: dict[int, list[tuple[np.ndarray, int]]] = {}
    for i in np.argsort(-lengths, kind="stable"):
        n, size = int(counts[i]), int(lengths[i])
        while n:
            fits = [room for room in groups if room >= size]
            room = min(fits, default=capacity)
            each = room // size
            config, times = groups[room].pop() if fits else (np.zeros(len(lengths), np.int64), -(-n // each))
            if fits and not groups[room]:
                del groups[room]
            full = min(times, n // each)
            parts = [(each, full)] if full == times else [(each, full), (n - each * full, 1), (0, times - full - 1)]
            for took, many in parts:
                if many > 0:
                    new = config.copy()
                    new[i] += took
                    groups.setdefault(room - took * size, []).append((new, many))
            n = n - each * full if full == times else 0
    return [x for group in groups.values() for x in group]


def make_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> Packing:
    """The plan for a histogram of lengths up to ``capacity``, ascending."""
    made: list[tuple[Configuration, int]] = []
    left, bound = counts.astype(np.int64).copy(), 0.0
    if len(lengths):
        cover, bound = solve(lengths, counts, capacity)
        for (i, n), amount in cover:
            times = min(int(amount + 1e-9), int((left[i] // n).min()))
            if times:
                made.append(((i, n), times))
                left[i] -= n * times
        rest = np.flatnonzero(left)
        for c, times in best_fit(lengths[rest], left[rest], capacity):
            i = np.flatnonzero(c)
            made.append(((rest[i], c[i]), times))
    rows, sequence, used = [], 0, np.zeros(len(lengths), np.int64)
    for (i, n), times in made:
        offset = 0
        for k, each in zip(i.tolist(), n.tolist(), strict=True):
            rows.append((lengths[k], used[k], sequence, times, each, offset))
            used[k] += each * times
            offset += each * int(lengths[k])
        sequence += times
    rows.sort()
    return Packing(Plan(*np.array(rows, np.int64).reshape(-1, 6).T), sequence, bound)


def _cut_pieces(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.for_words()
        for batch in batches:
            for part in pieces(batch, "text"):
                rows: list[list] = [[] for _ in range(5)]
                for doc, ids in zip(part["doc_id"].to_pylist(), encoder.encode(part["text"], END_ID), strict=True):
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity]
                        for column, x in zip(rows, (doc, k, start, len(piece), zlib.crc32(piece.astype("<u4", copy=False))), strict=True):
                            column.append(x)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each whole text's ids with id 0 after them, cut at ``capacity``.

    A null text is empty and gives one piece of length 1.
    """
    return docs.select("doc_id", "text").mapInArrow(_cut_pieces(capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Append ``sequence_id`` (long) and ``offset`` (long) to every row of ``rows``, which has ``length`` from 1 to ``capacity``.

    Rows of one length are interchangeable for the plan; among them a random order decides. In each sequence the
    offsets are gapless from 0. All other columns of ``rows`` come back as they are, whatever they are called; columns
    named like the new ones are replaced. Lengths without rows cost nothing; an empty table stays empty.
    """
    given = rows.drop("sequence_id", "offset")
    whole = F.struct(*[F.col(f"`{c}`") for c in given.columns]).alias("row")  # apart from the columns used here
    rows = materialize(given.select(whole, F.col("length").cast("long").alias("length"), F.rand(5).alias("u")), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    lengths = np.array(sorted(counts), np.int64)
    plan, _, _ = make_plan(lengths, np.array([counts[n] for n in lengths.tolist()], np.int64), capacity)
    # Ranks: a length may hold a third of all rows, so it is ranked in blocks.
    many = {n: ceil(c / RANK_ROWS) for n, c in counts.items() if c > RANK_ROWS}
    blocks = F.coalesce(F.create_map(*[F.lit(x) for kv in many.items() for x in kv])[F.col("length")], F.lit(1)) if many else F.lit(1)
    rows = rows.withColumn("block", F.floor(F.col("u") * blocks).cast("int"))
    sizes = rows.groupBy("length", "block").agg(F.count("*").alias("n"))
    starts = sizes.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("start"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "block").orderBy("u")) - 1)
    ranked = ranked.join(starts, ["length", "block"]).select("row", "length", (F.col("rank") + F.col("start")).alias("rank"))
    sent = rows.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        high = int(p.first.max(initial=0)) + 1 if len(p.first) else 1
        for batch in batches:
            n, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            # the last interval of the length that begins at or before the rank
            at = np.searchsorted(p.length.astype(float) * (high + 1.0) + p.first, n * (high + 1.0) + np.minimum(rank, high), "right") - 1
            inside = rank - p.first[at]
            sequence = p.sequence[at] + inside // p.each[at]
            offset = p.offset[at] + inside % p.each[at] * n
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(sequence), pa.array(offset)], ["row", "sequence_id", "offset"])

    schema = T.StructType([rows.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema).select("row.*", "sequence_id", "offset")
