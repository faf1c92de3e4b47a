"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets and components.

In a SuperMinHash signature each element of a set draws ranks for all positions from one random permutation, so the
positions are anti-correlated and the estimate varies less than with independent hashes. Element ranks fall into
levels 0, 1, 2, ...; once every position holds a rank below level j, no later level can matter and a set is done.
Sets larger than a few times the signature are done after level 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.components import connected_components
from threadloom.llm.storage import drop_tables, materialize
from threadloom.llm.text import cache_for, distinct, mix, pieces, shingle_sets, shingles, words

SHINGLE_WORDS = 5
#: A pair with similarity 0.8 shares none of 24 bands of 5 with probability below 1e-4, one with 0.85 below 1e-6.
BANDS, ROWS = 24, 5
SIZE = BANDS * ROWS
#: Standard deviations below the threshold at which an estimate still sends a pair to verification.
SLACK = 5.0
#: Members of a bucket that are compared with one another at once.
BLOCK = 512
#: Shingles of the documents in one block, on the average; long texts come in smaller blocks.
BLOCK_SHINGLES = 1_500_000

#: Classes with more copies than that, and than an equal share of all copies among ``MOST_SENT`` classes, are sent to all tasks.
LEAST_MANY, MOST_SENT = 500, 100_000

_U = np.uint64
_LEVEL = 53


def superminhash(hashes: np.ndarray, at: np.ndarray, m: int = SIZE) -> np.ndarray:
    """Signatures (sets x m, uint64) of the sets ``hashes[at[i]:at[i + 1]]``; an empty set keeps all bits set."""
    n = len(at) - 1
    sizes = np.diff(at)
    sig = np.full(n * m, ~_U(0))
    owner = np.repeat(np.arange(n), sizes)
    seed = mix(hashes, 20)
    draw = mix(seed, 21)
    k = ((draw >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
    np.minimum.at(sig, owner * m + k, mix(seed, 22) >> _U(64 - _LEVEL))
    open_ = (sig.reshape(n, m).max(1) >> _U(_LEVEL) > 0) & (sizes > 0)
    if open_.any():
        rest = open_[owner]
        seed, owner, k = seed[rest], owner[rest], k[rest]
        row = np.arange(len(seed))
        perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(seed), 1))
        perm[row, 0], perm[row, k] = k, 0
        for j in range(1, m):
            draw = mix(seed, 23 + 2 * j)
            k = j + ((draw >> _U(32)) * _U(m - j) >> _U(32)).astype(np.int64)
            row = np.arange(len(seed))
            picked = perm[row, k].copy()
            perm[row, k] = perm[row, j]
            perm[row, j] = picked
            np.minimum.at(sig, owner * m + picked, (_U(j) << _U(_LEVEL)) | mix(seed, 24 + 2 * j) >> _U(64 - _LEVEL))
            ids = np.unique(owner)
            still = np.zeros(n, bool)
            still[ids] = sig.reshape(n, m)[ids].max(1) >> _U(_LEVEL) > j
            rest = still[owner]
            if not rest.all():
                seed, owner, perm = seed[rest], owner[rest], perm[rest]
            if not len(seed):
                break
    return sig.reshape(n, m)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """(sets x BANDS) hashes of consecutive rows."""
    h = np.zeros((len(sig), BANDS), _U)
    parts = sig.reshape(len(sig), BANDS, ROWS)
    for j in range(ROWS):
        h = mix(h ^ parts[:, :, j], 4)
    return h


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache_for("minhash")
    for batch in batches:
        for piece in pieces(batch, "text"):
            sets, at = shingle_sets(piece["text"], SHINGLE_WORDS)
            n = np.diff(at)
            sig = superminhash(sets, at)
            bands = band_hashes(sig).astype(np.int64)
            small = mix(sig, 5).astype(np.uint32)
            marks = [hashlib.blake2b(sets[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() for i in range(len(n))]
            filled = np.repeat(n > 0, BANDS)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [piece["doc_id"], pa.array(n), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1)[filled])), pa.array([x.tobytes() for x in small], pa.binary())],
                ["doc_id", "n_shingles", "mark", "bands", "signature"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, mark, bands, signature): of each document's set of shingles, from its whole text.

    ``mark`` is a 128-bit digest of the whole set; ``signature`` has 32 bits of each position.
    """
    return docs.select("doc_id", "text").mapInArrow(_sketch, "doc_id long, n_shingles long, mark binary, bands array<long>, signature binary")


def _verify(least: float):
    """Keep the pairs whose full shingle sets have that Jaccard similarity at least."""
    per_mille = round(1000 * least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.select(["a", "b", "text_a", "text_b"])
            size = max(1, int(2_000_000 * texts.num_rows / max(1, texts.nbytes)))
            for i in range(0, texts.num_rows, size):
                piece = texts.slice(i, size)
                n = piece.num_rows
                both = pa.concat_arrays([piece["text_a"], piece["text_b"]])
                h, doc = shingles(words(both), 2 * n, SHINGLE_WORDS)
                sets, at = distinct(h, doc, 2 * n)
                keep = []
                for j in range(n):
                    x, y = sets[at[j] : at[j + 1]], sets[at[n + j] : at[n + j + 1]]
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(shared > 0 and 1000 * shared >= per_mille * (len(x) + len(y) - shared))
                yield piece.select(["a", "b"]).filter(pa.array(keep))

    return run


def verified(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b) of doc_ids whose documents are similar enough, on their full sets.

    Both joins are on doc_id, where one document can be in very many pairs; Spark's skew join splits those.
    """
    text = docs.select("doc_id", "text")
    with_b = pairs.join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.mapInArrow(_verify(least), "a long, b long")


def _promising(met: pa.Table, least: float) -> tuple[np.ndarray, ...]:
    """(x, y, same) of the rows of two blocks of a bucket whose signatures promise enough and whose components
    differ, for whom this is the first shared band; most alike first."""
    floor = SIZE * (least - SLACK * (least * (1 - least) / SIZE) ** 0.5)
    ids, roots, block = (met[c].to_numpy() for c in ("doc_id", "root", "block"))
    sig = np.frombuffer(b"".join(met["signature"].to_pylist()), np.uint32).reshape(-1, SIZE)
    bands = np.array(met["bands"].to_pylist(), np.int64).reshape(-1, BANDS)
    band, i, j = (met[c][0].as_py() for c in ("band", "i", "j"))
    right = np.flatnonzero(block == j)
    found = [np.zeros((3, 0), np.int64)]
    for x in np.flatnonzero(block == i):
        near = right[(roots[right] != roots[x]) & ((ids[right] > ids[x]) | (i != j))]
        same = (sig[near] == sig[x]).sum(1)
        fit = np.flatnonzero(same >= floor)
        fit = fit[np.argmax(bands[near[fit]] == bands[x], 1) == band]
        found.append(np.stack([np.full(len(fit), x), near[fit], same[fit]]))
    x, y, same = np.concatenate(found, 1)
    order = np.argsort(-same, kind="stable")
    return x[order], y[order], same[order]


_MET = "band int, hash long, i int, j int, doc_id long, root long, block int, bands array<long>, signature binary"


def _hopeful(least: float):
    """The members of two blocks of a bucket that are in a promising pair."""

    def run(met: pa.Table) -> pa.Table:
        x, y, _ = _promising(met, least)
        return met.take(pa.array(np.union1d(x, y)))

    return run


def _links(least: float):
    """Links among the members of two blocks that join components; pairs joined by earlier links are left out."""
    per_mille = round(1000 * least)

    def run(met: pa.Table) -> pa.Table:
        x, y, _ = _promising(met, least)
        ids, roots = met["doc_id"].to_numpy(), met["root"].to_numpy()
        sets, at = [], []
        for piece in pieces(met.select(["text"]).combine_chunks().to_batches()[0], "text"):
            h, ends = shingle_sets(piece["text"], SHINGLE_WORDS)
            sets += [h[ends[k] : ends[k + 1]] for k in range(len(ends) - 1)]
        above = {int(r): int(r) for r in roots}

        def top(r: int) -> int:
            while above[r] != r:
                above[r] = r = above[above[r]]
            return r

        for u, v in zip(x.tolist(), y.tolist(), strict=True):
            p, q = top(int(roots[u])), top(int(roots[v]))
            if p == q:
                continue
            shared = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
            if 1000 * shared >= per_mille * (len(sets[u]) + len(sets[v]) - shared):
                above[max(p, q)] = min(p, q)
                at.append((min(ids[u], ids[v]), max(ids[u], ids[v])))
        ends = np.array(at, np.int64).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return run


def _cross_links(buckets: DataFrame, sketch: DataFrame, docs: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(a, b): verified links between components that meet in a bucket.

    Only buckets in which several components meet are looked at. They are cut into blocks, and each pair of blocks
    is compared in one task, first on signatures; the texts follow only for members of promising pairs. So no task
    holds a whole bucket, and pairs never leave a task.
    """
    members = buckets.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    mixed = members.groupBy("band", "hash").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).where("low < high")
    mixed = mixed.select("band", "hash", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    at = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = members.join(mixed, ["band", "hash"]).withColumn("block", at).join(sketch.select("doc_id", "bands", "signature"), "doc_id")
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("band", "hash", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "root", "block", "bands", "signature")
    key = ["band", "hash", "i", "j"]
    hopeful = materialize(met.groupBy(*key).applyInArrow(_hopeful(least), _MET), "hopeful")
    links = materialize(hopeful.join(docs.select("doc_id", "text"), "doc_id").groupBy(*key).applyInArrow(_links(least), "a long, b long"), "links")
    drop_tables(hopeful)
    return links


def near_duplicate_links(docs: DataFrame, sketch: DataFrame, least: float) -> DataFrame:
    """(node, root) of documents that are linked with others; ``sketch`` has one row for each different set.

    Each bucket first offers one pair for each member: with the member that meets the most others in its bands.
    Where one component is left in a bucket, no further pair of it can change anything. In the other buckets all
    pairs between components are compared on their signatures, and the promising ones on their full sets.
    """
    banded = sketch.where("n_shingles > 0").select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "hash"))
    sizes = banded.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialize(banded.join(sizes, ["band", "hash"]), "buckets")
    weight = buckets.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    weighed = buckets.join(weight, "doc_id")
    hubs = weighed.groupBy("band", "hash").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("id"))).alias("top")).select("band", "hash", (-F.col("top.id")).alias("hub"))
    pairs = buckets.join(hubs, ["band", "hash"]).where("doc_id <> hub").select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    links = materialize(verified(pairs, docs, least), "links")
    roots = connected_components(links)
    more = _cross_links(buckets.select("doc_id", "n_shingles", "band", "hash"), sketch, docs, roots, least)
    drop_tables(buckets)
    if not more.isEmpty():
        drop_tables(roots)
        roots = connected_components(links.union(more))
    drop_tables(links, more)
    return roots


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents whose sets of 5-word shingles have Jaccard similarity ``least`` at least are linked; components are
    named by their smallest doc_id, and that document is kept. Equal sets are linked without going through bands,
    so any number of copies costs no pairs. A document without words (null, empty or blank text) is linked with
    nothing; one with fewer than five words has its whole sequence as only shingle. Repeated rows of one doc_id
    give repeated rows; the doc_id must not be null for a row to be linked.
    """
    sketch = materialize(sketches(docs), "sketches")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    # the first of each class by an aggregate, so that a class with very many copies is one row for each task that has some
    first = full.groupBy("mark").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "signature")).alias("first"), F.count("*").alias("copies"))
    first = materialize(first.select("mark", "copies", "first.*"), "classes")
    classes = first.select("mark", "copies", F.col("doc_id").alias("class_id"))
    leaders = first.dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "bands", "signature")
    leaders = materialize(leaders, "leaders")
    known = docs.where("doc_id is not null").select("doc_id", "text")
    texts = known.join(leaders.select("doc_id"), "doc_id", "left_semi")
    roots = near_duplicate_links(texts, leaders, least)
    named = classes.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select("mark", "copies", F.coalesce("root", "class_id").alias("component_id"))
    # classes with very many copies are few, and are sent to their rows; the rest meet by their mark
    many = max(LEAST_MANY, first.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] // MOST_SENT)
    large = F.broadcast(named.where(F.col("copies") > many).select("mark", "component_id"))
    rows = full.select("doc_id", "n_shingles", "mark")
    rest = rows.join(large.select("mark"), "mark", "left_anti").join(named.select("mark", "component_id"), "mark")
    alone = sketch.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    out = rows.join(large, "mark").select(*columns).union(rest.select(*columns)).union(alone)
    out = materialize(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "groups")
    drop_tables(sketch, first, leaders, roots)
    return out


def deduplicate(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """``docs`` without the near duplicates: one document of each component stays, the one with the smallest doc_id.

    Repeated rows of a kept doc_id become one row; rows without a doc_id stay.
    """
    gone = near_duplicates(docs, least).where("not kept").select("doc_id")
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    keyed = rest.where("doc_id is not null").dropDuplicates(["doc_id"])
    return keyed.union(rest.where("doc_id is null"))
