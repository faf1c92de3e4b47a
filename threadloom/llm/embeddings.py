"""Near duplicates among embeddings by a pivot-permutation index.

Some vectors of the table are reference points (pivots). Each vector is described by its ``NEAREST`` nearest pivots in
order, and entered into the inverted list of each of them. Two vectors that lie close see the same pivots nearby, so
those that share at least ``SHARED`` of them are retrieved from the lists and verified by their cosine in double
precision. The index is fitted on a bounded sample, and every vector is in it.

The pivots are bounded in number, so lists grow with the table. A list that is long is split by a second pivot: vectors
that share two pivots meet under the two smallest that they share, so with n vectors and p pivots the lists that are
compared have about n / p**2 of them, and p may stay as it is for tables a thousand times larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.components import connected_components
from threadloom.llm.storage import materialize

#: Nearest pivots that describe a vector, and how many of them two vectors must share to be compared. Of 2,000 pairs of
#: random directions in 64 dimensions at cosine 0.9, 0.998 share two of twelve with 800 pivots, 0.982 with 4,000 and 0.943
#: with 16,384; at 0.92 it is 0.9995, 0.996 and 0.977, at 0.95 at least 0.997.
NEAREST, SHARED = 12, 2
#: One pivot for so many vectors, from the least to the most: the size of the sample that the index is fitted on.
VECTORS_PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 12, 64, 16_384
#: Of pivots that are more alike than that only one is used, so a large group of near copies doesn't use them up.
PIVOT_COSINE = 0.9
#: Vectors of a list that are compared with one another at once, and those beyond which a list is split by a second pivot.
BLOCK, LONG = 512, 2048
#: Parts of lists with several blocks that are sent to all tasks; with more, they are joined by a shuffle.
SENT_PARTS = 200_000


def units(vectors: list[bytes], dim: int) -> np.ndarray:
    """Rows of length one, in double precision, of components as their column stores them."""
    kind = np.float32 if vectors and len(vectors[0]) == 4 * dim else np.float64
    x = np.frombuffer(b"".join(vectors), kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(sample: np.ndarray) -> np.ndarray:
    """The sample without vectors that are too like an earlier one."""
    kept = sample[:0]
    for i in range(0, len(sample), 256):
        part = sample[i : i + 256]
        part = part[(part @ kept.T).max(1, initial=-1) < PIVOT_COSINE]
        alike = part @ part.T >= PIVOT_COSINE
        use = np.zeros(len(part), bool)
        for k in range(len(part)):
            use[k] = not (alike[k, :k] & use[:k]).any()
        kept = np.concatenate([kept, part[use]])
    return kept


def _describe(pivots, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        n = min(NEAREST, len(p))
        for batch in batches:
            flat = batch["v"].flatten()
            # floats travel as floats: half the bytes, and the doubles that they stand for
            flat = (flat if flat.type == pa.float32() else flat.cast(pa.float64())).to_numpy()
            raw = [flat[i * dim : (i + 1) * dim].tobytes() for i in range(batch.num_rows)]
            tops = []
            for i in range(0, len(raw), 256):
                near = units(raw[i : i + 256], dim) @ p.T
                top = np.argpartition(-near, n - 1, axis=1)[:, :n]
                tops += np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1), 1).astype(np.int32).tolist()
            yield pa.RecordBatch.from_arrays([batch["class_id"], batch["copies"], pa.array(raw, pa.binary()), pa.array(tops, pa.list_(pa.int32()))], ["class_id", "copies", "raw", "pivots"])

    return run


def _compare(dim: int, least: float):
    """In two blocks of one pivot's list: links of each vector (a, null, n) and links that join components (a, b, null).

    A pair is looked at in the list of the smallest pivot that it shares, and in a split list, of the two smallest.
    """

    def run(met: pa.Table) -> pa.Table:
        ids, copies, block = (met[c].to_numpy() for c in ("class_id", "copies", "block"))
        pivot, second, i, j = (met[c][0].as_py() for c in ("pivot", "second", "i", "j"))
        v = units(met["raw"].to_pylist(), dim)
        described = np.array(met["pivots"].to_pylist(), np.int64)
        local, where = np.unique(described, return_inverse=True)
        has = np.zeros((len(ids), len(local)), np.float32)
        has[np.arange(len(ids))[:, None], where.reshape(described.shape)] = 1
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        shared = has[x] @ has[y].T >= min(SHARED, described.shape[1])
        before = has[:, (local < second) & (local != pivot)] if second >= 0 else has[:, local < pivot]
        shared &= before[x] @ before[y].T == 0
        # verification in double precision of what the lists retrieve
        close = shared & (v[x] @ v[y].T >= least - 1e-12)
        if i == j:
            close = np.triu(close, 1)
        left, right = np.nonzero(close)
        exact = np.einsum("nd,nd->n", v[x[left]], v[y[right]]) >= least
        left, right = x[left[exact]], y[right[exact]]
        n = np.bincount(left, weights=copies[right], minlength=len(ids)) + np.bincount(right, weights=copies[left], minlength=len(ids))
        above = np.arange(len(ids))

        def top(k: int) -> int:
            while above[k] != k:
                above[k] = k = above[above[k]]
            return k

        edges = []
        for s, t in zip(left.tolist(), right.tolist(), strict=True):
            p, q = top(s), top(t)
            if p != q:
                above[max(p, q)] = min(p, q)
                edges.append((ids[s], ids[t]))
        some = np.flatnonzero(n)
        a = [*ids[some].tolist(), *(int(e[0]) for e in edges)]
        b = [*[None] * len(some), *(int(e[1]) for e in edges)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array([*n[some].astype(np.int64).tolist(), *[None] * len(edges)], pa.int64())})

    return run


def _found(leaders: DataFrame, dim: int, least: float) -> DataFrame:
    """What ``_compare`` finds among ``leaders`` (class_id, copies, v), all with ``dim`` components."""
    spark = leaders.sparkSession
    n = leaders.count()
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, n // VECTORS_PER_PIVOT))
    u = F.shiftrightunsigned(F.xxhash64("class_id"), 11) / float(1 << 53)
    sample = leaders.where(u * n < wanted * 1.1 + 50).select("v", u.alias("u"), "class_id").orderBy("u", "class_id").limit(wanted).collect()
    pivots = spark.sparkContext.broadcast(choose_pivots(units([np.array(r["v"], np.float64).tobytes() for r in sample], dim)))
    described = leaders.select("class_id", "copies", "v").mapInArrow(_describe(pivots, dim), "class_id long, copies long, raw binary, pivots array<int>")
    described = materialize(described, "described")
    lists = described.select(F.explode("pivots").alias("pivot")).groupBy("pivot").agg(F.count("*").alias("n"))
    split = (F.col("n") > LONG) & F.lit(len(pivots.value) >= SHARED)
    # a row for each pivot, so MOST_PIVOTS bounds the broadcast
    posted = described.withColumn("pivot", F.explode("pivots")).join(F.broadcast(lists), "pivot")
    posted = posted.withColumn("second", F.explode(F.when(split, F.filter("pivots", lambda q: q > F.col("pivot"))).otherwise(F.array(F.lit(-1))))).drop("n")
    parts = posted.groupBy("pivot", "second").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    parts = materialize(parts, "parts")
    posted = posted.join(F.broadcast(parts) if parts.count() <= SENT_PARTS else parts, ["pivot", "second"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    posted = posted.withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    posted = posted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = posted.select("pivot", "second", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "class_id", "copies", "raw", "pivots", "block")
    return met.groupBy("pivot", "second", "i", "j").applyInArrow(_compare(dim, least), "a long, b long, n long")


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Rows are linked if the cosine of their embeddings is ``least`` at least. Equal embeddings form one class, which is
    searched once; its copies count among each other's links. Vectors that are null, empty or zero, or hold null or
    non-finite components, and rows without a vec_id, are linked with nothing; vectors with different numbers of
    components aren't compared. Each row counts as a vector, also where a vec_id is repeated. Only retrieval is
    approximate: every link returned is verified, see ``NEAREST`` for what may be missed.
    """
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("good", F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull())
    keyed = rows.select("vec_id", F.when(F.col("good"), F.xxhash64(F.lit(1), "embedding")).alias("h1"), F.when(F.col("good"), F.xxhash64(F.lit(2), "embedding")).alias("h2"), "good", "embedding")
    classes = keyed.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes")
    of = keyed.where("good").select("vec_id", F.col("embedding").alias("v"), "h1", "h2")
    leaders = of.join(classes, ["h1", "h2"]).where("vec_id = class_id").dropDuplicates(["class_id", "h1", "h2"]).select("class_id", "copies", "v")
    leaders = materialize(leaders, "leaders")
    parts = [_found(leaders.where(F.size("v") == r["d"]), r["d"], least) for r in leaders.select(F.size("v").alias("d")).distinct().collect()]
    spark = vectors.sparkSession
    found = spark.createDataFrame([], "a long, b long, n long")
    for part in parts:
        found = found.union(part)
    found = materialize(found, "found")
    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    named = classes.join(counts, F.col("class_id") == F.col("a"), "left").join(roots, F.col("class_id") == F.col("node"), "left")
    named = named.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class_id").alias("component_id"))
    out = keyed.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
