"""Importance resampling of a corpus towards a target: hashed n-gram features and Gumbel top-k.

The texts of a batch are joined with a sentinel between them and one pass of a regular expression finds the words of all.
The texts' offsets, searched for the words' places, say which text a word is in and so which n-grams would reach across
two texts; those are masked before the buckets are counted. A bucket's gain is the logarithm of how much likelier it is in
the target than in the corpus, a text's weight the sum of its features' gains, and adding Gumbel noise to the weights
before the largest are taken draws texts without replacement in proportion to their importance.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ordered import number_rows
from threadloom.llm.storage import materialize
from threadloom.llm.text import cache_for, pieces, raw

#: Words: letters, digits and all that isn't ASCII, after A-Z became a-z; in UTF-8 every byte from 0x80 belongs to such a character.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IN_WORD = np.array([WORD.match(bytes([b])) is not None for b in range(256)])
#: Stands between texts; no word holds it.
SENTINEL = b"\x00"
#: Hashes of words up to that long are kept by a worker, so many of them.
KEPT_BYTES, KEPT_WORDS = 64, 1 << 18


class Features(NamedTuple):
    bucket: np.ndarray
    doc: np.ndarray  # index of the text, ascending within one n
    n_words: np.ndarray  # of each text


class Hashes(dict):
    """crc32 of words; those of short words are kept, a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        h = zlib.crc32(word)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = h
        return h


def _kept() -> Hashes:
    return cache_for("resample").setdefault("crc32", Hashes())


def features(texts: pa.Array, least: int, most: int, buckets: int, kept: Hashes) -> Features:
    """The buckets of all runs of ``least`` to ``most`` words in each text, by the crc32 of the run."""
    data, at = raw(texts)
    whole = data.tobytes()
    joined = SENTINEL.join(whole[at[i] : at[i + 1]] for i in range(len(texts))).translate(_LOWER)
    begins = at[:-1] + np.arange(len(texts))  # of the texts in what is joined
    found = WORD.findall(joined)
    inner = _IN_WORD[np.frombuffer(joined, np.uint8)]
    inner[1:] &= ~inner[:-1]  # only a word's first byte is left
    doc = np.searchsorted(begins, np.flatnonzero(inner), "right") - 1
    n = len(found)
    hashed = np.fromiter(map(kept.__getitem__, found), np.uint32, n)
    all_buckets, all_docs = [], []
    for size in range(1, min(most, n) + 1):
        if size > 1:
            # the runs one word longer: their hash goes on from where the shorter run's ended
            hashed = np.fromiter((zlib.crc32(b" " + w, h) for w, h in zip(found[size - 1 :], hashed[: n - size + 1].tolist(), strict=True)), np.uint32, n - size + 1)
        if size >= least:
            inside = doc[: n - size + 1] == doc[size - 1 :]
            all_buckets.append((hashed % buckets)[inside].astype(np.int64))
            all_docs.append(doc[: n - size + 1][inside])
    none = np.zeros(0, np.int64)
    return Features(np.concatenate(all_buckets or [none]), np.concatenate(all_docs or [none]), np.bincount(doc, minlength=len(texts)))


def bucket_counts(texts: DataFrame, least: int, most: int, buckets: int) -> DataFrame:
    """(bucket, n) of all rows of ``texts`` (text): at most one row for each bucket leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _kept()
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                total += np.bincount(features(piece["text"], least, most, buckets, kept).bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def learn_gains(corpus: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Each bucket's gain in thousandths: how much likelier it is in ``target`` than in ``corpus``, add-one smoothed.

    Counts cover all rows of both (text). There are ``buckets`` gains whatever the tables hold; without rows on both
    sides all are 0.
    """
    spark = corpus.sparkSession
    mine = bucket_counts(corpus, least, most, buckets).withColumnRenamed("n", "s")
    theirs = bucket_counts(target, least, most, buckets).withColumnRenamed("n", "t")
    counts = spark.range(buckets).select(F.col("id").alias("bucket")).join(mine, "bucket", "left").join(theirs, "bucket", "left").na.fill(0)
    counts = materialize(counts, "buckets")
    totals = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    gain = F.floor(1000 * F.ln((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))
    out = np.zeros(buckets, np.int64)
    for r in counts.crossJoin(F.broadcast(totals)).select("bucket", gain.alias("gain")).toLocalIterator():  # totals is one row
        out[r["bucket"]] = r["gain"]
    return out


def weigh(docs: DataFrame, gains: np.ndarray, least: int = 1, most: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of ``docs`` (doc_id, text), from its whole text."""
    model = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _kept()
        gain = model.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                f = features(piece["text"], least, most, len(gain), kept)
                n = np.bincount(f.doc, minlength=piece.num_rows)
                # sums of whole numbers, so doubles are exact up to 2**53
                weight = np.bincount(f.doc, weights=gain[f.bucket], minlength=piece.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([piece["doc_id"], pa.array(f.n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, least: int = 1, most: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of ``docs`` (doc_id, text).

    Of the rows with ``least_words`` words at least, ``percent`` in a hundred (rounded down) with the highest scores
    are drawn, ties going to the smaller doc_id; ``rank`` numbers those and is null for the others. A null or empty
    text has no words and weight 0, and is never drawn unless ``least_words`` is 0. Each row counts, also one whose
    doc_id is repeated; such rows share their noise. A null doc_id is hashed as empty and comes last among ties. Other
    columns don't matter; an empty table gives no rows, an empty target still gives gains (those of rare buckets are
    higher). A corpus is read twice and its texts are never shuffled.
    """
    gains = learn_gains(docs, target, least, most, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    scored = weigh(docs, gains, least, most).withColumn("score", F.col("weight") + noise)
    able = F.col("n_words") >= least_words
    scored = scored.withColumn("able", able)
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    numbered = number_rows(scored, order, lambda df: materialize(df, "scored"))
    drawn = numbered.agg(F.expr(f"count_if(able) * {int(percent)} div 100").alias("drawn"))
    rank = F.when(F.col("able") & (F.col("number") <= F.col("drawn")), F.col("number"))
    out = numbered.crossJoin(F.broadcast(drawn)).withColumn("rank", rank)  # drawn is one row
    return out.select("doc_id", "n_words", "n_features", "weight", "score", "rank")
