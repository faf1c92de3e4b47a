"""Benchmark decontamination by spaced-seed hashing.

A mask names the token positions of a seed that count; those it skips may differ. Test and training texts are
hashed under the same masks and joined on the hashes. Each hit fixes an alignment of a document with an item, and
the tokens around it are compared one by one, so that passages with substituted words are found as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.storage import materialize
from threadloom.llm.text import cache_for, mix, pieces, words

#: With any two substitutions in 13 tokens, one of these still has all its positions clean somewhere. Shorter items have ``short_masks``.
MASKS = ("111100011", "1000101111", "11110101")
#: A passage of so many tokens (the whole item, if shorter) with this share of equal ones is contamination.
LEAST_TOKENS, LEAST_SHARE = 13, 0.8
#: Text of the items that are sent to all tasks, in bytes; a larger benchmark is joined on its seeds.
BENCHMARK_BYTES = 8_000_000
#: Bits of the seeds' hashes by which tasks leave out, before that join, what no item has: 8 MB.
FILTER_BITS = 26
#: Hits that are paired up at once.
HITS_AT_ONCE = 2_000_000
#: Contaminated doc_ids up to that many are sent to all tasks.
SENT_IDS = 500_000

_U = np.uint64
_MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64), 30) | _U(1)
#: Any character that is no letter and no digit, for the regular expressions of Arrow.
_NO_TOKEN = r"[^\p{L}\p{N}]+"


def tokens(texts: pa.Array):
    """Words of letters and digits in lower case; everything else separates them."""
    return words(pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), _NO_TOKEN, " "))


def _seeds(hashes: np.ndarray, doc: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes under ``mask`` and the token at which each begins; none reaches into another text."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.full(n, _U(len(mask) * 1_000_003 + int(mask, 2)))
    for place in (i for i, x in enumerate(mask) if x == "1"):
        h += hashes[place : place + n] * _MULTIPLIERS[place]
    at = np.flatnonzero(doc[:n] == doc[len(mask) - 1 :])
    return h[at], at


def short_masks(n: int) -> list[str]:
    """Masks over a whole item of ``n`` tokens, of which one is clean wherever the substitutions that the share allows are.

    The item is cut into two more parts than there are substitutions, and each mask leaves out as many parts.
    """
    changed = int(n * (1 - LEAST_SHARE) + 1e-9)
    parts = np.arange(n) * (changed + 2) // n
    return ["".join("0" if x in left_out else "1" for x in parts) for left_out in combinations(range(changed + 2), changed)]


class Seeds(NamedTuple):
    """The items' seeds under one mask, by hash and then by the hash of the seed one token before in the same item."""

    hashes: np.ndarray  # all different ones, in order
    befores: np.ndarray  # the same of the seeds before
    key: np.ndarray  # of each seed, in order: number of its hash and of the one before (0: there is none)
    token: np.ndarray  # where it begins
    filter: np.ndarray  # by the top 20 bits of a hash, whether a seed has them


class Index(NamedTuple):
    """The items' tokens, and their seeds by mask."""

    ids: np.ndarray
    hash: np.ndarray
    begin: np.ndarray  # of each item among the tokens; one more for the end
    seeds: dict[str, Seeds]


def _befores(h: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each seed the hash of the one that begins a token earlier in its text, and whether there is one."""
    before, there = np.zeros(len(h), _U), np.zeros(len(h), bool)
    before[1:] = h[:-1]
    there[1:] = (at[1:] == at[:-1] + 1) & (doc[at[1:]] == doc[at[:-1]])
    return before, there


def _sorted_seeds(h: np.ndarray, at: np.ndarray, doc: np.ndarray) -> Seeds:
    before, there = _befores(h, at, doc)
    hashes, number = np.unique(h, return_inverse=True)
    befores = np.unique(before[there])
    key = number * (len(befores) + 1) + np.where(there, np.searchsorted(befores, before) + 1, 0)
    order = np.argsort(key, kind="stable")
    filter_ = np.zeros(1 << 20, bool)
    filter_[(h >> _U(44)).astype(np.int64)] = True
    return Seeds(hashes, befores, key[order], at[order], filter_)


def index(ids: list[int], texts: list[str | None]) -> Index:
    w = tokens(pa.array(texts, pa.string()))
    count = np.bincount(w.doc, minlength=len(ids)) if len(ids) else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(count)])
    seeds = {}
    short = np.unique(count[(count > 0) & (count < LEAST_TOKENS)])
    for mask in [*MASKS, *(m for n in short for m in short_masks(int(n)))]:
        h, at = _seeds(w.hash, w.doc, mask)
        size = count[w.doc[at]]
        use = size >= LEAST_TOKENS if mask in MASKS else size == len(mask)
        seeds[mask] = _sorted_seeds(h[use], at[use], w.doc)
    return Index(np.array(ids, np.int64), w.hash, begin, seeds)


def _number(of: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value among ``known``, and whether it is there."""
    at = np.searchsorted(known, of)
    return at, (known[np.minimum(at, len(known) - 1)] == of) if len(known) else np.zeros(len(of), bool)


def _alignments(hashes: np.ndarray, doc: np.ndarray, known: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, token of the document less token of the item) of every alignment with a hit, once each.

    A hit whose seeds follow on another hit is left out before it is paired up, since it belongs to the same alignment.
    So a stretch of words that repeat with any period costs as many hits as it has alignments, and not as many as
    they have tokens. An item of up to four tokens is found whole or not at all, so its first alignment is enough.
    """
    n_items, lowest = len(known.ids), len(known.hash)
    span = len(hashes) + lowest + 1
    found = np.zeros(0, np.int64)
    for mask, seeds in known.seeds.items():
        h, at = _seeds(hashes, doc, mask)
        before, there = _befores(h, at, doc)
        maybe = seeds.filter[(h >> _U(44)).astype(np.int64)]
        h, at, before, there = h[maybe], at[maybe], before[maybe], there[maybe]
        number, is_known = _number(h, seeds.hashes)
        number, at, before, there = number[is_known], at[is_known], before[is_known], there[is_known]
        width = len(seeds.befores) + 1
        place, follows = _number(before, seeds.befores)
        follows &= there
        low, high = np.searchsorted(seeds.key, number * width), np.searchsorted(seeds.key, (number + 1) * width)
        # of the seeds with this hash those that follow on the same seed stand together
        own = number * width + place + 1
        skip, resume = np.where(follows, np.searchsorted(seeds.key, own), high), np.where(follows, np.searchsorted(seeds.key, own, "right"), high)
        for start, stop in ((low, skip), (resume, high)):
            n = stop - start
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // HITS_AT_ONCE)) + 1):
                many = n[part]
                left = np.repeat(at[part], many)
                right = seeds.token[np.repeat(start[part] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                if not len(left):
                    continue
                item = np.searchsorted(known.begin, right, "right") - 1
                code = (doc[left] * n_items + item) * span + (left - right + lowest)
                if "0" not in mask:  # exact: hits are in order of the document
                    pair = code // span
                    order = np.lexsort((code, pair))
                    code = code[order][np.concatenate([[True], np.diff(pair[order]) > 0])]
                found = np.union1d(found, code)
    pair, shift = np.divmod(found, span)
    return pair // max(n_items, 1), pair % max(n_items, 1), shift - lowest


def _passage(equal: np.ndarray, least: int) -> tuple[int, int] | None:
    """The longest stretch with enough equal tokens, if some ``least`` tokens in a row have them."""
    need = LEAST_SHARE * least - 1e-9
    total = np.concatenate([[0], np.cumsum(equal)])
    if len(equal) < least or (total[least:] - total[:-least]).max() < need:
        return None
    score = total - LEAST_SHARE * np.arange(len(total)) + 1e-9 * np.arange(len(total))
    lowest, highest = np.minimum.accumulate(score), np.maximum.accumulate(score[::-1])[::-1]
    # the farthest end whose score reaches that of the begin; only record lows can begin the longest stretch
    ends = len(highest) - np.searchsorted(highest[::-1], lowest, "left") - 1
    begin = int(np.argmax(ends - np.arange(len(ends))))
    return begin, int(ends[begin])


def _best(equal_of, alignments, ids: list[int], item_ids: np.ndarray, doc_begin: np.ndarray, begin: np.ndarray) -> list[tuple]:
    """The best passage of each document and item, over their alignments."""
    best: dict[tuple[int, int], tuple] = {}
    for d, i, shift in alignments:
        a, b = int(begin[i]), int(begin[i + 1])
        size = b - a
        a, b = max(a, int(doc_begin[d]) - shift), min(b, int(doc_begin[d + 1]) - shift)
        equal = equal_of(a, b, shift)
        found = _passage(equal, min(LEAST_TOKENS, size))
        if found:
            start, end = found
            n = int(equal[start:end].sum())
            row = (n, -(end - start), -(a + shift + start - int(doc_begin[d])), size)
            best[d, i] = max(best.get((d, i), row), row)
    return [(ids[d], int(item_ids[i]), n, -m, n / -m, -at, size) for (d, i), (n, m, at, size) in best.items()]


def _matches(ids: list[int], w, known: Index) -> list[tuple]:
    found = _alignments(w.hash, w.doc, known)
    doc_begin = np.searchsorted(w.doc, np.arange(len(ids) + 1))
    return _best(lambda a, b, shift: w.hash[a + shift : b + shift] == known.hash[a:b], zip(*(x.tolist() for x in found), strict=True), ids, known.ids, doc_begin, known.begin)


_FOUND = "doc_id long, item_id long, n_equal long, n_tokens long, share double, start_token long, item_tokens long"


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item of which the document holds a passage, with the best such passage.

    ``docs`` (doc_id, text) and ``benchmark`` (item_id, text). Tokens are runs of letters and digits in lower case. A
    passage is ``LEAST_TOKENS`` tokens or the whole item, if shorter, of which ``LEAST_SHARE`` are equal at the same
    distance; ``start_token``, ``n_tokens`` and ``n_equal`` tell where it is and how alike. Among passages the one with
    most equal tokens counts, then the shorter, then the first. Texts of one item_id are items of their own. An item of one to four tokens is found where
    it stands without a change. Null and empty texts, texts without a token and rows without an id match nothing.
    Repeated rows of documents give repeated rows.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > BENCHMARK_BYTES:
        return _found_by_join(texts, items)
    rows = items.orderBy("item_id", "text").collect()
    known = spark.sparkContext.broadcast(index([r["item_id"] for r in rows], [r["text"] for r in rows]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_for("decontamination")
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield _batch(_matches(piece["doc_id"].to_pylist(), tokens(piece["text"]), known.value), _FOUND)

    return texts.mapInArrow(search, _FOUND)


def _nullable(values: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64), mask=~there)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def _found_by_join(texts: DataFrame, items: DataFrame) -> DataFrame:
    """What ``find_contamination`` returns, for a benchmark of any size: hits by a join on the seeds' hashes, then each
    document and item that meet joined with their texts and compared along the alignments that were hit."""
    spark = texts.sparkSession
    items = items.withColumn("item", F.xxhash64("item_id", "text"))
    texts = texts.withColumn("doc", F.xxhash64("doc_id", "text"))
    lengths = list(range(1, LEAST_TOKENS))
    every = [*MASKS, *dict.fromkeys(m for n in lengths for m in short_masks(n))]

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                w = tokens(piece["text"])
                count, begin = np.bincount(w.doc, minlength=piece.num_rows), np.searchsorted(w.doc, np.arange(piece.num_rows))
                for mask in every:
                    h, at = _seeds(w.hash, w.doc, mask)
                    size = count[w.doc[at]]
                    use = size >= LEAST_TOKENS if mask in MASKS else size == len(mask)
                    h, at = h[use], at[use]
                    yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), piece["item"].take(pa.array(w.doc[at])), pa.array(at - begin[w.doc[at]]), _nullable(*_befores(h, at, w.doc))], ["hash", "item", "item_at", "item_before"])

    seeds = materialize(items.select("item", "text").mapInArrow(item_seeds, "hash long, item long, item_at long, item_before long"), "seeds")
    top = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    words_ = seeds.select(F.shiftright(top, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 63 as int))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    there = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in words_.toLocalIterator():  # at most 2 ** 20 rows
        there[r["word"]] = r["bits"]
    sent = spark.sparkContext.broadcast(there)

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_for("decontamination")
        for batch in batches:
            for piece in pieces(batch, "text"):
                w = tokens(piece["text"])
                begin = np.searchsorted(w.doc, np.arange(piece.num_rows))
                for mask in every:
                    h, at = _seeds(w.hash, w.doc, mask)
                    before, there = _befores(h, at, w.doc)
                    bit = (h >> _U(64 - FILTER_BITS)).astype(np.int64)
                    use = sent.value[bit >> 6] >> (bit & 63) & 1 == 1
                    h, at, before, there = h[use], at[use], before[use], there[use]
                    yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), piece["doc"].take(pa.array(w.doc[at])), pa.array(at - begin[w.doc[at]]), _nullable(before, there)], ["hash", "doc", "doc_at", "doc_before"])

    hits = texts.select("doc", "text").distinct().mapInArrow(doc_seeds, "hash long, doc long, doc_at long, doc_before long").join(seeds, "hash").where("not coalesce(doc_before = item_before, false)")
    shifts = hits.select("doc", "item", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    # as many alignments as two texts have tokens, at most
    pairs = materialize(shifts.groupBy("doc", "item").agg(F.sort_array(F.collect_list("shift")).alias("shifts")), "alignments")
    met = pairs.join(texts, "doc").join(items.select("item", "item_id", F.col("text").alias("item_text")), "item").select("doc_id", "item_id", "text", "item_text", "shifts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_for("decontamination")
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1)
                d, i = tokens(r["text"]), tokens(r["item_text"])
                ends = np.array([0, len(d.hash)]), np.array([0, len(i.hash)])
                yield _batch(_best(lambda a, b, shift: d.hash[a + shift : b + shift] == i.hash[a:b], [(0, 0, x) for x in r["shifts"][0].as_py()], r["doc_id"].to_pylist(), r["item_id"].to_numpy(), *ends), _FOUND)

    return met.mapInArrow(compare, _FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a passage of ``benchmark``; rows without a doc_id stay."""
    found = materialize(find_contamination(docs, benchmark).select("doc_id").distinct(), "contaminated")
    gone = F.broadcast(found) if found.count() <= SENT_IDS else found
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
