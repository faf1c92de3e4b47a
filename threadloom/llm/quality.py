"""Quality of documents by Bradley-Terry ranking.

A pair of labelled documents, one good and one bad, is a preference for the good one. The model gives every document a
strength that is linear in its features, and the mean logistic loss on the differences of strengths, over all such pairs of
all labelled documents, is made least. The strengths of the labelled documents then say where good begins: at the quantile
that leaves as large a share below it as is labelled bad. Scores are strengths on a scale from 0 to 1 on which that quantile
is ``THRESHOLD``.

The pairs are never listed. What a document's partners of the other label add to the loss and its slope depends on their
strengths alone, and smoothly, so all strengths of a label can be put on the Chebyshev nodes of unit intervals, each shared
among the nodes of its interval such that sums over polynomials, and up to rounding over the logistic function, stay what
they are. A step of the descent is two sums over the labelled documents, made in Spark: the weights of the nodes, and the
slope.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.storage import drop_tables, materialize
from threadloom.llm.text import PIECE_BYTES, cache_for, mix, pieces, powers, prefix_hash, raw, words

#: Weight of the squared norm in the loss.
RIDGE = 1e-4
#: The descent ends where the slope is no longer than this, or after so many steps (10 to 20 are usual).
FLAT, MOST_STEPS = 1e-7, 200
#: Lengths of a step that are tried at once, and former steps that shape the next one.
LENGTHS, MEMORY = (4.0, 2.0, 1.0, 0.5, 0.125), 10
#: Unit intervals of strengths around 0, and nodes of each. The loss is never more than at weights 0, log 2, so the norm of
#: the weights is below 118, that of features below 1.7, and strengths stay inside.
INTERVALS, NODES = 512, 16
#: Rows of features that are worked on at once.
ROWS_AT_ONCE = 4096
#: Sums in a row that a task sends: fewer rows to shuffle, but each is a column to plan and compile.
SUMS_A_ROW = 4
#: The score at the quantile; a document with this score or more is predicted good.
THRESHOLD = 0.7

#: Buckets for word shapes, and for steps of each of the shares in ``_shares``.
SHAPES, STEPS_OF_A_SHARE = 2048, 12
_U = np.uint64
#: Classes of bytes in a word's shape: letters in two cases, digits; other bytes stand for themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _CLASS[0x80:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_LETTER = np.isin(_CLASS, [ord("a"), ord("A")])
N_SHARES = 7
#: Features of a document: shapes, steps of shares, and one that says there are no words.
WIDTH = SHAPES + N_SHARES * STEPS_OF_A_SHARE + 1


class Sparse(NamedTuple):
    """Rows of features: those of row i are at[i] to at[i + 1]."""

    at: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        """Each row's sum by itself, so equal rows have equal ones wherever they stand."""
        n = len(self.at) - 1
        return np.bincount(np.repeat(np.arange(n), np.diff(self.at)), weights=self.value * w[self.column], minlength=n)

    def transposed_times(self, c: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * np.repeat(c, np.diff(self.at)), minlength=WIDTH)


def _shape_buckets(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A bucket for each word's shape: its classes of bytes, each run as one."""
    kind = _CLASS[data]
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[start] = True
    runs = np.concatenate([[0], np.cumsum(first)])
    p = prefix_hash(kind[first])
    a, b = runs[start], runs[end]
    return (mix((p[b] - p[a]) * powers(len(p), inverse=True)[a], 5) % _U(SHAPES)).astype(np.int64)


def _shares(data: np.ndarray, w, n_docs: int) -> np.ndarray:
    """For each text: shares of words like the one before, of distinct words, of words in capitals, of words without a
    letter and of words with inner or trailing signs, and of bytes that are signs and digits."""
    n = np.maximum(np.bincount(w.doc, minlength=n_docs), 1)

    def share(of_words: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, weights=of_words, minlength=n_docs) / n

    def in_words(of_bytes: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_bytes)])
        return total[w.end] - total[w.start]

    again = np.zeros(len(w.doc), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    by_doc = np.lexsort((w.hash, w.doc))
    h, d = w.hash[by_doc], w.doc[by_doc]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    kind = _CLASS[data]
    letters, capitals = in_words(_LETTER[data]), in_words(kind == ord("A"))
    digits, length = in_words(kind == ord("0")), w.end - w.start
    signs = length - letters - digits
    bytes_of = np.maximum(np.bincount(w.doc, weights=length, minlength=n_docs), 1)
    distinct = np.bincount(d[new], minlength=n_docs) / np.sqrt(n)  # grows like the root of the number of words
    return np.stack(
        [share(again), distinct, share((capitals == letters) & (letters > 1)), share(letters == 0), share(signs > 1), np.bincount(w.doc, weights=signs, minlength=n_docs) / bytes_of, np.bincount(w.doc, weights=digits, minlength=n_docs) / bytes_of]
    )


def features(texts: pa.Array) -> Sparse:
    """Features of each text, whole: frequencies of word shapes as a vector of length one, and one feature for the step
    that each share falls on. Texts without words have one feature alone."""
    n_docs = len(texts)
    w = words(texts)
    if not len(w.doc):
        return Sparse(np.arange(n_docs + 1), np.full(n_docs, WIDTH - 1), np.ones(n_docs))
    data, _ = raw(texts)
    n = np.bincount(w.doc, minlength=n_docs)
    cell, count = np.unique(w.doc * SHAPES + _shape_buckets(data, w.start, w.end), return_counts=True)
    doc, shape = cell // SHAPES, cell % SHAPES
    value = np.sqrt(count / n[doc])  # squares of a text's values sum to one
    shares = _shares(data, w, n_docs)
    # steps at halves, quarters, eighths ... of the largest value, so small shares are told apart
    step = np.clip(np.floor(-2 * np.log2(np.maximum(shares, 2.0**-6) / np.array([1, 16, 1, 1, 1, 1, 1])[:, None])), 0, STEPS_OF_A_SHARE - 1).astype(np.int64)
    has = np.flatnonzero(n)
    docs, columns, values = [doc], [shape], [value]
    for k in range(N_SHARES):
        docs.append(has)
        columns.append(SHAPES + k * STEPS_OF_A_SHARE + step[k, has])
        values.append(np.full(len(has), 0.5))
    none = np.flatnonzero(n == 0)
    d, c, v = np.concatenate([*docs, none]), np.concatenate([*columns, np.full(len(none), WIDTH - 1)]), np.concatenate([*values, np.ones(len(none))])
    order = np.argsort(d, kind="stable")
    return Sparse(np.searchsorted(d[order], np.arange(n_docs + 1)), c[order], v[order])


class Ranking(NamedTuple):
    weights: np.ndarray
    quantile: float  # strength at which good begins
    scale: float

    def scores(self, x: Sparse) -> np.ndarray:
        start = np.log(THRESHOLD / (1 - THRESHOLD))
        z = (x.times(self.weights) - self.quantile) * self.scale + start
        # what falls on the quantile itself has the threshold, not a number next to it
        return np.where(z == start, THRESHOLD, 1 / (1 + np.exp(-np.clip(z, -500, 500))))


#: The sum over all labelled rows of a function of some of them, an array of the given length.
Total = Callable[[Callable[[Sparse, np.ndarray], np.ndarray], int], np.ndarray]

_NODE = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_TO_NODES = chebvander(_NODE, NODES - 1).T * 2 / NODES
_TO_NODES[0] /= 2
_N_NODES = INTERVALS * NODES
_STRENGTH = np.repeat(np.arange(INTERVALS) - INTERVALS // 2, NODES) + (np.tile(_NODE, INTERVALS) + 1) / 2


def _shared(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of each strength's interval, and the strength's share on each."""
    interval = np.clip(np.floor(s), -INTERVALS // 2, INTERVALS // 2 - 1)
    share = chebvander(np.clip(2 * (s - interval) - 1, -1, 1), NODES - 1) @ _TO_NODES
    return ((interval.astype(np.int64) + INTERVALS // 2) * NODES)[:, None] + np.arange(NODES), share


def _on_nodes(s: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights of the nodes for bad rows, then for good ones."""
    node, share = _shared(s)
    return np.bincount((label[:, None] * _N_NODES + node).ravel(), weights=share.ravel(), minlength=2 * _N_NODES)


def _mean_loss(bad: np.ndarray, good: np.ndarray, pairs: float) -> float:
    b, g = np.flatnonzero(bad), np.flatnonzero(good)
    return float(sum(good[i] * (np.logaddexp(0, _STRENGTH[b] - _STRENGTH[i]) @ bad[b]) for i in g)) / pairs


def _pulls(bad: np.ndarray, good: np.ndarray, n_bad: float, n_good: float) -> np.ndarray:
    """For a strength on each node, as a bad row's and as a good one's: the mean slope of its pairs' losses."""
    b, g = np.flatnonzero(bad), np.flatnonzero(good)
    # an interval more on either side, for strengths that are rounded to the other side of an edge
    low, high = min(b[0], g[0]) // NODES - 1, max(b[-1], g[-1]) // NODES + 2
    out = np.zeros((2, _N_NODES))
    for i in range(max(low, 0) * NODES, min(high, INTERVALS) * NODES):
        out[0, i] = good[g] @ (1 / (1 + np.exp(_STRENGTH[g] - _STRENGTH[i]))) / n_good
        out[1, i] = -bad[b] @ (1 / (1 + np.exp(_STRENGTH[i] - _STRENGTH[b]))) / n_bad
    return out


def _slopes(x: Sparse, label: np.ndarray, w: np.ndarray, pulls: np.ndarray) -> np.ndarray:
    """Sums of pulls times features, of bad rows and then of good ones."""
    node, share = _shared(x.times(w))
    pull = (pulls[label[:, None], node] * share).sum(1)
    return np.concatenate([x.transposed_times(np.where(label == k, pull, 0.0)) for k in (0, 1)])


def _direction(slope: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Down the slope, bent by former steps and the changes of slope over them (L-BFGS)."""
    d, used = -slope, []
    for step, change in reversed(moves):
        used.append(step @ d / (step @ change))
        d = d - used[-1] * change
    if moves:
        step, change = moves[-1]
        d = d * (step @ change) / (change @ change)
    else:
        d = d / np.linalg.norm(slope)
    for (step, change), share in zip(moves, reversed(used), strict=True):
        d = d + step * (share - change @ d / (step @ change))
    return d


def _ordered(s: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers."""
    u = (s + 0.0).view(_U)
    return u ^ np.where(u >> _U(63), ~_U(0), _U(1 << 63))


def _ranked(total: Total, w: np.ndarray, ranks: list[int]) -> list[float]:
    """The strengths with these ranks, from 0, among all rows: digit by digit, of 16 bits each."""
    known, left = [0] * len(ranks), list(ranks)
    for shift in (48, 32, 16, 0):

        def count(x: Sparse, label: np.ndarray, shift: int = shift, known: tuple[int, ...] = tuple(known)) -> np.ndarray:
            u = _ordered(x.times(w)) >> _U(shift)
            return np.concatenate([np.bincount((u[u >> _U(16) == _U(k)] & _U(0xFFFF)).astype(np.int64), minlength=1 << 16) for k in known])

        for i, n in enumerate(total(count, len(ranks) << 16).reshape(len(ranks), -1)):
            upto = np.cumsum(n)
            digit = int(np.searchsorted(upto, left[i], "right"))
            left[i] -= int(upto[digit - 1]) if digit else 0
            known[i] = known[i] << 16 | digit
    u = np.array(known, _U)
    return (u ^ np.where(u >> _U(63), _U(1 << 63), ~_U(0))).view(np.float64).tolist()


def _least(total: Total) -> Ranking:
    """The ranking of least loss over all pairs of rows labelled 1 and 0."""
    n_bad, n_good = total(lambda x, label: np.bincount(label, minlength=2), 2)
    w = np.zeros(WIDTH)
    if not n_bad or not n_good:
        return Ranking(w, 1.0 if n_bad else 0.0, 1.0)

    def slope_at(w: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        pulls = _pulls(bad, good, n_bad, n_good)
        of_bad, of_good = total(lambda x, label: _slopes(x, label, w, pulls), 2 * WIDTH).reshape(2, -1)
        return of_bad / n_bad + of_good / n_good + RIDGE * w

    bad, good = _on_nodes(np.zeros(2), np.arange(2)).reshape(2, -1) * [[n_bad], [n_good]]
    loss, slope, moves, scale = np.log(2), slope_at(w, bad, good), [], 1.0
    for _ in range(MOST_STEPS):
        if np.linalg.norm(slope) <= FLAT:
            break
        d = scale * _direction(slope, moves)

        def tried(x: Sparse, label: np.ndarray, w: np.ndarray = w, d: np.ndarray = d) -> np.ndarray:
            s, along = x.times(w), x.times(d)
            return np.concatenate([_on_nodes(s + t * along, label) for t in LENGTHS])

        nodes = total(tried, len(LENGTHS) * 2 * _N_NODES).reshape(len(LENGTHS), 2, -1)
        losses = [_mean_loss(*n, n_bad * n_good) + RIDGE / 2 * float((w + t * d) @ (w + t * d)) for t, n in zip(LENGTHS, nodes, strict=True)]
        best = int(np.argmin(losses))
        if losses[best] >= loss:  # former steps mislead, the slope is steep, or the rest is rounding
            if not moves and scale < 1e-6:
                break
            moves, scale = [], scale / 64
            continue
        step, (bad, good) = LENGTHS[best] * d, nodes[best]
        w, loss, before, scale = w + step, losses[best], slope, 1.0
        slope = slope_at(w, bad, good)
        if step @ (slope - before) > 0:
            moves = [*moves, (step, slope - before)][-MEMORY:]
    n = bad + good
    mean = n @ _STRENGTH / n.sum()
    last, first = _ranked(total, w, [int(n_bad) - 1, int(n_bad)])
    return Ranking(w, (last + first) / 2, float(2 / (np.sqrt(max(n @ (_STRENGTH - mean) ** 2 / n.sum(), 0)) + 1e-12)))


def fit(x: Sparse, label: np.ndarray) -> Ranking:
    """Learn strengths from preferences of all rows labelled 1 over all rows labelled 0.

    With labels of one kind there is no preference: all strengths are 0 and all documents are predicted to be of that
    kind (of kind 1 if there are none at all).
    """
    label = label.astype(np.int64)
    return _least(lambda of, width: of(x, label))


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, known, columns, values) for every row of ``docs`` (doc_id, text): whether it has a text, and its features.

    A null text counts as empty, repeated doc_ids stay apart, and other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_for("quality")
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                x = features(piece["text"])
                at = pa.array(x.at, pa.int32())
                columns, values = pa.ListArray.from_arrays(at, pa.array(x.column, pa.int32())), pa.ListArray.from_arrays(at, pa.array(x.value, pa.float64()))
                yield pa.RecordBatch.from_arrays([piece["doc_id"], piece["text"].is_valid(), columns, values], ["doc_id", "known", "columns", "values"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, known boolean, columns array<int>, values array<double>")


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Sparse]]:
    """Some rows at a time, with their features."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(first, ROWS_AT_ONCE)
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(part["columns"]).to_numpy())])
            yield part, Sparse(at, part["columns"].flatten().to_numpy(), part["values"].flatten().to_numpy())


def learn_from(rows: DataFrame, labels: DataFrame) -> Ranking:
    """``fit`` for all ``rows`` (as ``featured`` returns them) that ``labels`` (doc_id, label) calls good (1) or bad (0).

    Rows with other labels, null ones, null doc_ids and null texts teach nothing. What is labelled is written once to the
    shared folder, each sum over it is a job, and sums alone come to the driver.
    """
    known = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    # both sides are shuffled, however many labels there are; features are small beside texts
    learned = materialize(rows.where("known").join(known.hint("merge"), "doc_id").select("label", "columns", "values"), "quality")

    def total(of: Callable[[Sparse, np.ndarray], np.ndarray], width: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache_for("quality")
            held = np.zeros(n_rows * SUMS_A_ROW)
            for part, x in _sparse(batches):
                held[:width] += of(x, part["label"].to_numpy().astype(np.int64))
            held = held.reshape(n_rows, SUMS_A_ROW)
            key = np.flatnonzero(held.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(v) for v in held[key].T)], ["key", *names])

        n_rows, names = -(-width // SUMS_A_ROW), [f"v{i}" for i in range(SUMS_A_ROW)]
        # decimals are added exactly, so the order in which tasks end doesn't matter
        exact = [F.sum(F.col(v).cast("decimal(38,18)")).cast("double").alias(v) for v in names]
        sums = learned.mapInArrow(run, f"key long, {' double, '.join(names)} double").groupBy("key").agg(*exact).toArrow()
        out = np.zeros((n_rows, SUMS_A_ROW))
        out[sums["key"].to_numpy()] = np.stack([sums[v].to_numpy() for v in names], 1)
        return out.ravel()[:width]

    ranking = _least(total)
    drop_tables(learned)
    return ranking


def learn_ranking(docs: DataFrame, labels: DataFrame) -> Ranking:
    """``learn_from`` for all texts of ``docs`` (doc_id, text)."""
    return learn_from(featured(docs), labels)


def score_features(rows: DataFrame, ranking: Ranking) -> DataFrame:
    """(doc_id, score, predicted) for every row, as ``featured`` returns them."""
    model = rows.sparkSession.sparkContext.broadcast(ranking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_for("quality")
        for part, x in _sparse(batches):
            s = model.value.scores(x)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(s), pa.array(s >= THRESHOLD).cast(pa.int32())], ["doc_id", "score", "predicted"])

    return rows.select("doc_id", "columns", "values").mapInArrow(run, "doc_id long, score double, predicted int")


def score_quality(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs`` (doc_id, text), from its whole text.

    A null text counts as empty, and so does one without words. Rows with equal texts have equal scores, repeated
    doc_ids are scored each by itself, and other columns don't matter.
    """
    return score_features(featured(docs), ranking)
