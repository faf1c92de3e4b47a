"""Hard negatives by threshold joins with norm bounds over an inverted index.

Anchors meet the vectors in blocks. In a block the components of the vectors are an inverted index by groups of dimensions;
of each vector the leading dimensions are left out as long as their norm, times that of the anchors' leading dimensions,
can't reach the threshold. An anchor's partial scores accumulate over the indexed groups, vectors are pruned once what
they have and the norms of what remains stay below the threshold, and the survivors' scores are computed whole. Thresholds
begin high and are lowered for the anchors whose windows (the best of the same label, then the best of other labels between
two bounds) aren't full yet, until they are or everything is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.storage import materialize

#: Components of vectors and of anchors that meet in a block.
ROW_COMPONENTS, ANCHOR_COMPONENTS = 1 << 21, 1 << 20
#: Anchors that are searched at once, and dimensions in a group of the index.
AT_ONCE, GROUP = 64, 16
#: The first threshold as a share of the largest score there can be, and what it is lowered by.
FIRST, LOWER = 0.8, 0.6
#: Whole numbers below this are exact as doubles.
EXACT = float(1 << 53)
#: Lengths of vectors with a row of their own in a broadcast.
SENT_LENGTHS = 10_000
_LONG = (1 << 63) - 1


def _norms(x: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norms of the leading dimensions up to each edge, rounded up a little."""
    squares = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)], axis=1)[:, edges]
    return np.sqrt(squares) * (1 + 1e-9)


class Index:
    """The inverted index of a block of vectors."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.edges = [*range(0, max(x.shape[1], 1), GROUP), x.shape[1]]
        self.norms = _norms(x, self.edges)

    def search(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, vector, score) of all pairs whose score reaches the anchor's ``least``."""
        edges, last = self.edges, len(self.edges) - 1
        of_q = _norms(q, edges)
        # groups of each vector that are left out: even with all anchors' largest norms they stay below every threshold
        start = (self.norms[:, 1:] * of_q[:, 1:].max(0) < least.min()).sum(1)
        rows = np.argsort(start, kind="stable")
        rows = rows[: np.searchsorted(start[rows], last)]  # vectors covered by the bound have no postings
        acc = np.zeros((len(q), len(rows)))
        for g in range(last - 1, -1, -1):
            posted = np.searchsorted(start[rows], g, "right")
            if not posted:
                break
            part = slice(edges[g], edges[g + 1])
            acc[:, :posted] += q[:, part] @ self.x[rows[:posted], part].T
            rest = np.maximum(start[rows], g)  # groups whose products are still to come
            alive = (acc + of_q[:, rest] * self.norms[rows, rest] + 0.5 >= least[:, None]).any(0)
            if alive.sum() < 0.7 * len(rows):
                rows, acc = rows[alive], acc[:, alive]
        rest = start[rows]
        near, far = np.nonzero(acc + of_q[:, rest] * self.norms[rows, rest] + 0.5 >= least[:, None])
        far = rows[far]
        score = np.empty(len(near))
        for i in range(0, len(near), 1 << 16):
            score[i : i + (1 << 16)] = np.einsum("nd,nd->n", q[near[i : i + (1 << 16)]], self.x[far[i : i + (1 << 16)]])
        found = score >= least[near]
        return near[found], far[found], score[found]


def _all_pairs(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for components so large that doubles would round: whole numbers of any size, nothing pruned."""
    whole = [np.array([[int(c) for c in row] for row in m.tolist()], object).reshape(m.shape) for m in (q, x)]
    near, far = np.divmod(np.arange(len(q) * len(x)), max(len(x), 1))
    scores = (whole[0] @ whole[1].T).reshape(-1) if x.shape[1] else np.zeros(len(near), int)
    return near, far, np.array([min(max(s, -_LONG), _LONG) for s in scores], object)


def _first(keys: list[np.ndarray], group: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first ``k`` of each group, by ``keys`` from the least weighty on."""
    order = np.lexsort([*keys, group])
    g = group[order]
    begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(begins, np.diff(np.append(begins, len(g))))
    return order[place < k]


def _table(of: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, vec_id, label and whole-numbered components."""
    of = of.combine_chunks()
    flat = np.concatenate([c.flatten().cast(pa.float64()).to_numpy() for c in of["v"].chunks] or [np.zeros(0)])
    x = np.floor(scale * flat).reshape(of.num_rows, int(of["dim"][0].as_py()) if of.num_rows else 0)
    return of["row"].to_numpy(), of["vec_id"].to_numpy(), of["label"].to_numpy(), x


def _rounds(q: np.ndarray, x: np.ndarray, begin: np.ndarray, floor: np.ndarray, full) -> Iterator[tuple[np.ndarray, tuple]]:
    """Searches with lower and lower thresholds: the anchors that are done after each, and the pairs found for them.

    ``full(anchors, pairs, least)`` says which of these anchors need no more.
    """
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(x.shape[1], 1) >= EXACT:
        yield np.arange(len(q)), _all_pairs(q, x)
        return
    index, open_ = Index(x), np.arange(len(q))
    least = begin
    while len(open_):
        near, far, score = index.search(q[open_], least[open_])
        done = full(open_, (near, far, score), least[open_]) | (least[open_] <= floor[open_])
        place = np.cumsum(done) - 1
        mine = done[near]
        if done.any():
            yield open_[done], (place[near[mine]], far[mine], score[mine])
        open_ = open_[~done]
        lower = least * LOWER
        least = np.where(lower <= 0.02 * begin, floor, np.maximum(lower, floor))


def _positives(scale: int, k: int):
    """The first ``k`` of the anchor's own label in a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        if left.num_rows and right.num_rows:
            a_row, _, a_label, q = _table(left, scale)
            row, vec, label, x = _table(right, scale)
            by = np.argsort(label, kind="stable")
            bounds = np.searchsorted(label[by], np.unique(a_label)), np.searchsorted(label[by], np.unique(a_label), "right")
            for value, low, high in zip(np.unique(a_label), *bounds, strict=True):
                mine, same = np.flatnonzero(a_label == value), by[low:high]
                for i in range(0, len(mine) if len(same) else 0, AT_ONCE):
                    some = mine[i : i + AT_ONCE]
                    with np.errstate(over="ignore"):
                        most = np.sqrt((q[some] ** 2).sum(1)) * np.sqrt((x[same] ** 2).sum(1).max())

                    def full(open_, pairs, least, some=some, same=same):
                        near, far, _ = pairs
                        return np.bincount(near[a_row[some[open_[near]]] != row[same[far]]], minlength=len(open_)) >= k

                    for done, (near, far, score) in _rounds(q[some], x[same], FIRST * most, np.full(len(some), -np.inf), full):
                        anchor, of = some[done[near]], same[far]
                        other = a_row[anchor] != row[of]
                        anchor, of, score = anchor[other], of[other], score[other]
                        top = _first([row[of], vec[of], -score], anchor, k)
                        out.append([a_row[anchor[top]], row[of[top]], vec[of[top]], score[top]])
        return _result(out, ["anchor", "row", "vec_id", "score"])

    return run


def _negatives(scale: int, k: int, low: int, high: int):
    """For each positive of an anchor the first ``k`` of other labels whose score is in its window, in a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        if left.num_rows and right.num_rows:
            a_row, _, a_label, q = _table(left, scale)
            row, vec, label, x = _table(right, scale)
            scores = left.combine_chunks()["scores"].to_pylist()
            width = max(len(s) for s in scores)
            # low * p <= 100 * n <= high * p, in whole numbers; no window where no n can be
            bounds = [[(-(-low * p // 100), high * p // 100) for p in s] + [(1, 0)] * (width - len(s)) for s in scores]
            for i in range(0, len(q), AT_ONCE):
                some = np.arange(i, min(i + AT_ONCE, len(q)))
                window = np.array([bounds[j] for j in some], object).reshape(len(some), width, 2)
                lo, hi = window[:, :, 0].astype(float), window[:, :, 1].astype(float)
                empty = window[:, :, 0] > window[:, :, 1]
                lo[empty], hi[empty] = np.inf, -np.inf
                use = np.flatnonzero(~empty.all(1))
                some, lo, hi, window = some[use], lo[use], hi[use], window[use]
                if not len(some):
                    continue

                def inside(open_, pairs, some=some, window=window, lo=lo, hi=hi):
                    """Which pairs have another label and a score within each window; a column for each positive."""
                    near, far, score = pairs
                    exact = score.dtype != object
                    of = open_[near]
                    a, b = (lo, hi) if exact else (window[:, :, 0], window[:, :, 1])
                    return (a_label[some[of]] != label[far])[:, None] & (score[:, None] >= a[of]) & (score[:, None] <= b[of])

                def full(open_, pairs, least, lo=lo, inside=inside):
                    hit = inside(open_, pairs)
                    n = np.stack([np.bincount(pairs[0][hit[:, j]], minlength=len(open_)) for j in range(hit.shape[1])], 1)
                    return ((n >= k) | (least[:, None] <= lo[open_])).all(1)

                floor = lo.min(1)
                begin = np.maximum(floor, np.where(np.isinf(lo), np.inf, np.maximum(lo, hi * 0.9)).min(1))
                for done, pairs in _rounds(q[some], x, begin, floor, full):
                    hit = inside(done, pairs)
                    near, far, score = pairs
                    for j in range(width):
                        at = np.flatnonzero(hit[:, j])
                        anchor, of, s = some[done[near[at]]], far[at], score[at]
                        top = _first([row[of], vec[of], -s], anchor, k)
                        out.append([a_row[anchor[top]], np.full(len(top), j + 1), row[of[top]], vec[of[top]], s[top]])
        return _result(out, ["anchor", "positive", "row", "vec_id", "score"])

    return run


def _result(parts: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    def column(k: int) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(p[k].astype(np.int64) for p in parts)]), pa.int64())

    return pa.table({name: column(k) for k, name in enumerate(names)})


def mine_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score) for ``vectors``.

    ``vectors`` has vec_id, label and embedding; its rows for which ``is_anchor`` holds are anchors. A component x counts
    as floor(scale * x), the score of two rows is the inner product of such whole numbers, and higher scores come
    first, then smaller vec_ids. An anchor's positives are its first ``positives`` other rows of the same label (all
    if there are fewer); for each, its negatives are the first ``negatives`` rows of other labels whose score lies from
    ``low`` to ``high`` hundredths of the positive's, so a positive with a score below 0 has none.

    Rows with a null vec_id, label, vector or component, or one that isn't finite, take no part. Vectors of different
    lengths have no score with each other. Every row counts as one, also where vec_ids repeat; an anchor that is
    repeated is an anchor each time. Scores beyond a long count as the largest or smallest one. No anchors, and
    an empty table, give no rows. Anchors are a stated query set; with r of n rows anchors, blocks of both are
    compared, so vectors travel once for every block of anchors (16,384 of 64 components).
    """
    spark = vectors.sparkSession
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce((F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"), F.size("embedding").alias("dim"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), sound.alias("sound"))
    rows = materialize(rows.where("sound").drop("sound").withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("anchors")).where("anchors > 0")
    size = F.greatest("dim", F.lit(1))
    lengths = lengths.select("dim", F.ceil(F.col("n") * size / ROW_COMPONENTS).cast("int").alias("blocks"), F.ceil(F.col("anchors") * size / ANCHOR_COMPONENTS).cast("int").alias("anchor_blocks"))
    lengths = F.broadcast(lengths) if lengths.count() <= SENT_LENGTHS else lengths

    def dealt(df: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        placed = df.join(lengths, "dim").withColumn(own, F.pmod(F.xxhash64("row"), F.col(own_blocks)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1))).drop("blocks", "anchor_blocks", "is_anchor")

    key = ["dim", "anchor_block", "block"]
    against = dealt(rows, "block", "blocks", "anchor_block", "anchor_blocks").groupBy(*key)
    anchors = rows.where("is_anchor").select(*[F.col(c).alias(c) for c in rows.columns])  # columns of their own, for both sides of a cogroup
    found = dealt(anchors, "anchor_block", "anchor_blocks", "block", "blocks").groupBy(*key).cogroup(against)
    found = found.applyInArrow(_positives(scale, positives), "anchor long, row long, vec_id long, score long")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    chosen = found.withColumn("positive", F.row_number().over(best).cast("long")).where(F.col("positive") <= positives)
    chosen = materialize(chosen.select("anchor", "positive", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # as many scores for an anchor as it has positives
    windows = chosen.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("positive", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))
    asking = anchors.join(windows, F.col("row") == F.col("anchor")).drop("anchor")
    met = dealt(asking, "anchor_block", "anchor_blocks", "block", "blocks").groupBy(*key).cogroup(against)
    met = met.applyInArrow(_negatives(scale, negatives, low, high), "anchor long, positive long, row long, vec_id long, score long")
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id", "row")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = ranked.select("anchor", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(chosen, ["anchor", "positive"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", F.col("positive").cast("int").alias("positive_rank"), "rank", "negative_id", "positive_score", "negative_score")
