"""Removal of repeated byte strings by a depth-limited radix sort of all suffixes.

Only the first ``WINDOW`` bytes of a suffix matter, so the sort stops there, and suffixes that are equal so far form
one group: a window that repeats. The sort runs most significant digit first, and a pass deals out only the
suffixes whose group may still hold several documents:

* digit 1 is the window's anchor: of its strings of ``ANCHOR`` bytes the one with the least hash. Equal windows
  have equal anchors at equal places. Neighbouring windows share an anchor; such a run travels as one record.
* digit 2 is the run's whole content. Equal runs are equal windows throughout, settled at once.
* digit 3, the window itself, is dealt out only where runs with the same anchor differ.

Digits are compared by fingerprints (96 bits and more within a bucket), so groups are ordered by fingerprint, not
by alphabet. Documents are cut into blocks in order of doc_id. A group's smallest document is then in its first
block, so what a block needs to know of all others is one bit for each of its digits: whether an earlier block has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.storage import free_shuffles, materialize
from threadloom.llm.text import cache_for, mix, powers, prefix_hash, raw

WINDOW = 50
ANCHOR = 20
#: Text of one block, and of one range of doc_ids, in bytes.
BLOCK_BYTES, RANGE_BYTES = 1_000_000, 24_000_000
#: Digits that one bucket compares at once, on the average.
BUCKET_DIGITS = 250_000
#: An anchor with more different contents than that in one block sends them straight to the last pass.
HOT = 16

_U = np.uint64
_BLOCK = "block long, ids binary, ends binary, blob binary, carried binary"


def _pack(block: int, ids: list[int], texts: list[bytes], carried: list[pa.Array]) -> pa.RecordBatch:
    ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
    blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
    return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "ids": [np.array(ids, np.int64).tobytes()], "ends": [ends.tobytes()], "blob": pa.array([blob], pa.binary()), "carried": pa.array([_stream(pa.concat_arrays(carried))], pa.binary())})


def _stream(rows: pa.Array) -> bytes:
    """Rows as bytes: an Arrow stream of one column."""
    out = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([rows], ["carried"])
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive documents; equal doc_ids stay together."""
    ids: list[int] = []
    texts: list[bytes] = []
    carried: list[pa.Array] = []
    held = n = 0
    part = None
    for batch in batches:
        begin = 0
        for k, (p, i, t) in enumerate(zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True)):
            part = p
            if held >= BLOCK_BYTES and i != ids[-1]:
                yield _pack((part << 32) + n, ids, texts, [*carried, batch["carried"].slice(begin, k - begin)])
                ids, texts, carried, begin, held, n = [], [], [], k, 0, n + 1
            ids.append(i)
            texts.append(t or b"")
            held += len(texts[-1])
        carried.append(batch["carried"].slice(begin))
    if ids:
        yield _pack((part << 32) + n, ids, texts, carried)


class Block:
    """A block's documents, and its runs of windows by anchor."""

    def __init__(self, ids: bytes, ends: bytes, blob: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.at = np.concatenate([[0], np.frombuffer(ends, np.int64)])
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, int(self.at[-1]))), np.uint8)
        size = len(self.data)
        self.starts = self.ends = self.offset = self.run_doc = np.zeros(0, np.int64)
        self.anchor = self.content = np.zeros(0, _U)
        if size < WINDOW:
            return
        self.p, self.inverse = prefix_hash(self.data), powers(size, inverse=True)
        n = size - ANCHOR + 1
        value = mix((self.p[ANCHOR:] - self.p[:n]) * self.inverse[:n], 7)
        low, at = value, np.arange(n, dtype=np.int32)
        width, goal = 1, WINDOW - ANCHOR + 1
        while width < goal:
            step = min(width, goal - width)
            left = low[:-step] <= low[step:]
            low, at = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:])
            width += step
        # windows that don't reach into the next document
        lengths = np.diff(self.at)
        inside = np.zeros(size + 1, np.int8)
        fit = lengths >= WINDOW
        inside[self.at[:-1][fit]] += 1
        np.subtract.at(inside, self.at[1:][fit] - WINDOW + 1, 1)
        inside = np.cumsum(inside[: len(at)], dtype=np.int8) > 0
        new = inside.copy()
        new[1:] &= ~((at[1:] == at[:-1]) & inside[:-1])
        begins = self.at[:-1][fit]
        new[begins] = True
        self.starts = np.flatnonzero(new)
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | new[1:]
        self.ends = np.flatnonzero(stop) + WINDOW
        where = at[self.starts]
        self.offset = where - self.starts
        self.anchor = value[where]
        self.run_doc = np.searchsorted(self.at, self.starts, "right") - 1
        h = (self.p[self.ends] - self.p[self.starts]) * self.inverse[self.starts]
        self.content = mix(h ^ mix((self.offset * 4096 + self.ends - self.starts).astype(_U), 8), 9)
        # runs in order of (anchor, content, document): one entry for each different content, led by its first document
        order = np.lexsort((self.run_doc, self.content, self.anchor))
        a, c = self.anchor[order], self.content[order]
        new_a = np.concatenate([[True], a[1:] != a[:-1]])
        new_c = new_a | np.concatenate([[True], c[1:] != c[:-1]])
        self.order, self.entry = order, np.cumsum(new_c) - 1
        self.lead = order[new_c]
        self.entry_anchor, self.entry_content = a[new_c], c[new_c]
        group = (np.cumsum(new_a) - 1)[new_c]
        many = np.bincount(group)[group]
        self.hot = many > HOT
        # of a hot anchor one entry goes out, under a content that no other block has
        self.sends = ~self.hot | np.concatenate([[True], group[1:] != group[:-1]])

    def sent(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, content) of the entries that pass 1 and 2 deal out, ordered by anchor."""
        own = mix(np.array([block], np.int64).astype(_U), 11)[0]
        content = np.where(self.hot, self.entry_content ^ own, self.entry_content)
        return self.entry_anchor[self.sends], content[self.sends]

    def settle(self, known: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry: whether an earlier block has its content, and whether its windows must be compared.

        ``known`` and ``mixed`` are the replies to ``sent``.
        """
        earlier, compare = np.zeros(len(self.sends), bool), self.hot.copy()
        cold = ~self.hot[self.sends]
        earlier[self.sends & ~self.hot] = known[cold]
        compare[self.sends & ~self.hot] = mixed[cold] & ~known[cold]
        return earlier, compare

    def windows(self, compare: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, check, document, first byte) of all windows of the runs that lead the entries to compare."""
        runs = self.lead[compare]
        n = self.ends[runs] - self.starts[runs] - WINDOW + 1
        first = (np.repeat(self.starts[runs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(runs) else np.zeros(0, np.int64)).astype(np.int32)
        run = np.repeat(runs, n).astype(np.int32)
        key = mix((self.p[first + WINDOW] - self.p[first]) * self.inverse[first], 12) if len(first) else np.zeros(0, _U)
        place = (self.starts[run] + self.offset[run] - first).astype(_U)
        return key, mix(self.anchor[run] ^ mix(place, 13), 14).astype(np.uint32), self.run_doc[run], first

    def removed(self, earlier: np.ndarray, windows: tuple[np.ndarray, ...], seen: np.ndarray) -> np.ndarray:
        """Mark of every byte that goes. ``seen``: of each window, whether an earlier block has it."""
        size = len(self.data)
        change = np.zeros(size + 1, np.int32)
        if len(self.starts):
            first_doc = self.ids[self.run_doc[self.lead]]
            gone = earlier[self.entry] | (self.ids[self.run_doc[self.order]] > first_doc[self.entry])
            runs = self.order[gone]
            np.add.at(change, self.starts[runs], 1)
            np.subtract.at(change, self.ends[runs], 1)
            key, check, doc, first = windows
            if len(key):
                order = np.lexsort((doc, check, key))
                k, c = key[order], check[order]
                new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
                leader = self.ids[doc[order][new]][np.cumsum(new) - 1]
                out = np.empty(len(key), bool)
                out[order] = self.ids[doc[order]] > leader
                out |= seen
                # the runs that share a lead's content in the same document repeat its windows there
                lead_of = first[out]
                np.add.at(change, lead_of, 1)
                np.subtract.at(change, lead_of + WINDOW, 1)
                self._again(out, first, change)
        return np.cumsum(change[:size], dtype=np.int32) > 0

    def _again(self, out: np.ndarray, first: np.ndarray, change: np.ndarray) -> None:
        """Carry a lead run's windows over to further runs of the same content in documents with the leading doc_id."""
        entry_of = np.empty(len(self.starts), np.int64)
        entry_of[self.order] = self.entry
        # rows may share the leading doc_id; they don't remove from one another either
        twins = self.order[(self.ids[self.run_doc[self.order]] == self.ids[self.run_doc[self.lead]][self.entry]) & (self.order != self.lead[self.entry])]
        if not len(twins):
            return
        gone = np.zeros(len(self.data) + 1, bool)
        gone[first[out]] = True
        total = np.zeros(len(gone) + 1, np.int32)
        np.cumsum(gone, out=total[1:])
        lead = self.lead[entry_of[twins]]
        n = self.ends[lead] - self.starts[lead] - WINDOW + 1
        some = total[self.starts[lead] + n] > total[self.starts[lead]]
        for run, source, width in zip(twins[some], lead[some], n[some], strict=True):
            at = self.starts[run] + np.flatnonzero(gone[self.starts[source] : self.starts[source] + width])
            np.add.at(change, at, 1)
            np.subtract.at(change, at + WINDOW, 1)


def _dealt(block: int, top: np.ndarray, n_buckets: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One record for each bucket: the columns' entries whose ``top`` falls into it, in order; none without entries."""
    if not len(top):
        return
    bucket = ((top >> _U(32)) * _U(n_buckets) >> _U(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ids, begin = np.unique(bucket[order], return_index=True)
    stop = np.append(begin[1:], len(order))
    cut = [[c[order[i:j]].tobytes() for i, j in zip(begin, stop, strict=True)] for c in columns]
    names = ["first", "second"][: len(columns)]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([block] * len(ids), pa.int64()), *(pa.array(x, pa.binary()) for x in cut)], ["bucket", "block", *names])


def _collected(replies: bytes | None, lengths: bytes | None, top: np.ndarray, n_buckets: int, n_marks: int) -> list[np.ndarray]:
    """The marks that ``_dealt``'s buckets sent back, one array for each mark, in the order of ``top``."""
    out = [np.zeros(len(top), bool) for _ in range(n_marks)]
    if not len(top):
        return out
    bucket = ((top >> _U(32)) * _U(n_buckets) >> _U(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bits, at, begin = np.frombuffer(replies, np.uint8), 0, 0
    for n in np.frombuffer(lengths, np.int64):
        for mark in out:
            width = (n + 7) // 8
            mark[order[begin : begin + n]] = np.unpackbits(bits[at : at + width], count=n).astype(bool)
            at += width
        begin += n
    return out


def _compare(second: type, with_mixed: bool):
    """In one bucket: which entries an earlier block has, and which share their first digit with other contents."""

    def run(table: pa.Table) -> pa.Table:
        blocks = table["block"].to_numpy()
        first = [np.frombuffer(x, np.uint64 if not with_mixed else np.uint32) for x in table["first"].to_pylist()]
        other = [np.frombuffer(x, second) for x in table["second"].to_pylist()]
        sizes = np.array([len(x) for x in first])
        a, b, of = np.concatenate(first), np.concatenate(other), np.repeat(blocks, sizes)
        order = np.lexsort((of, b, a))
        x, y = a[order], b[order]
        new_a = np.concatenate([[True], x[1:] != x[:-1]])
        new = new_a | np.concatenate([[True], y[1:] != y[:-1]])
        known = np.empty(len(a), bool)
        known[order] = of[order] > of[order][new][np.cumsum(new) - 1]
        marks = [known]
        if with_mixed:
            group = np.cumsum(new_a) - 1
            mixed = np.empty(len(a), bool)
            mixed[order] = np.bincount(group, weights=new)[group] > 1
            marks.append(mixed)
        ends = np.cumsum(sizes)
        bits = [b"".join(np.packbits(m[e - n : e]).tobytes() for m in marks) for n, e in zip(sizes, ends, strict=True)]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "n": pa.array(sizes.astype(np.int64)), "bits": pa.array(bits, pa.binary())})

    return run


def _replies(dealt: DataFrame, second: type, with_mixed: bool) -> DataFrame:
    """(block, lengths, bits): the buckets' answers, joined for each block in order of buckets."""
    answers = dealt.groupBy("bucket").applyInArrow(_compare(second, with_mixed), "block long, bucket long, n long, bits binary")
    return answers.groupBy("block").applyInArrow(_joined, "block long, lengths binary, bits binary")


def _joined(table: pa.Table) -> pa.Table:
    table = table.sort_by("bucket")
    return pa.table({"block": table["block"][:1], "lengths": pa.array([table["n"].to_numpy().astype(np.int64).tobytes()], pa.binary()), "bits": pa.array([b"".join(table["bits"].to_pylist())], pa.binary())})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    cache_for("repeats")
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept, carried): each document without the strings that a smaller doc_id also has.

    A byte of a text goes if any ``WINDOW`` bytes in a row that hold it also stand in a document with a smaller
    doc_id; strings are compared on the texts as given, never across documents. ``spans`` are the removed runs
    (start, end in bytes); ``kept`` is what remains, as bytes, since a cut can fall inside a character. ``carried`` is
    a struct of the columns named in ``carry``, and ``null_text``, so that nothing must be joined back to the result. A
    null text is empty; repeated rows of one doc_id don't remove from one another; a row without a doc_id neither loses
    nor removes anything; an empty table stays empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(F.col("text").isNull().alias("null_text"), *[F.col(f"`{c}`") for c in carry]).alias("carried"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges, n_buckets = max(1, ceil(total / RANGE_BYTES)), max(1, ceil(total / 16 / BUCKET_DIGITS))
    dealt = rows.where("doc_id is not null").repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id")
    blocks = materialize(dealt.withColumn("part", F.spark_partition_id().cast("long")).select("part", "doc_id", "text", "carried").mapInArrow(_cut, _BLOCK), "blocks")
    free_shuffles(spark)  # of the texts, which stand in the blocks now

    def first_passes(batches):
        for r in _rows(batches):
            b = Block(r["ids"], r["ends"], r["blob"])
            if len(b.starts):
                anchor, content = b.sent(r["block"])
                yield from _dealt(r["block"], anchor, n_buckets, anchor.astype(np.uint32), content)

    def last_pass(batches):
        for r in _rows(batches):
            b = Block(r["ids"], r["ends"], r["blob"])
            if len(b.starts):
                known, mixed = _collected(r["bits1"], r["lengths1"], b.sent(r["block"])[0], n_buckets, 2)
                key, check, _, _ = b.windows(b.settle(known, mixed)[1])
                yield from _dealt(r["block"], key, n_buckets, key, check)

    def finish(batches):
        for r in _rows(batches):
            b = Block(r["ids"], r["ends"], r["blob"])
            gone = np.zeros(len(b.data), bool)
            if len(b.starts):
                known, mixed = _collected(r["bits1"], r["lengths1"], b.sent(r["block"])[0], n_buckets, 2)
                earlier, compare = b.settle(known, mixed)
                windows = b.windows(compare)
                gone = b.removed(earlier, windows, _collected(r["bits2"], r["lengths2"], windows[0], n_buckets, 1)[0])
            ids, kept, spans, removed = [], [], [], []
            for i, doc in enumerate(b.ids):
                g = gone[b.at[i] : b.at[i + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                ids.append(int(doc))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                removed.append(int(g.sum()))
                kept.append(b.data[b.at[i] : b.at[i + 1]][~g].tobytes())
            rows_ = pa.ipc.open_stream(r["carried"]).read_all()["carried"].combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(b.at)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), rows_], ["doc_id", "n_bytes", "n_removed", "spans", "kept", "carried"])

    record = "bucket long, block long, first binary, second binary"
    plain = blocks.drop("carried")
    answers = _replies(plain.mapInArrow(first_passes, record), np.uint64, True)
    answers = materialize(answers.select("block", F.col("lengths").alias("lengths1"), F.col("bits").alias("bits1")), "answers")
    free_shuffles(spark)
    more = _replies(plain.join(answers, "block", "left").mapInArrow(last_pass, record), np.uint32, False)
    more = materialize(more.select("block", F.col("lengths").alias("lengths2"), F.col("bits").alias("bits2")), "answers")
    free_shuffles(spark)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("spans", spans), ("kept", T.BinaryType()), ("carried", rows.schema["carried"].dataType))])
    cleaned = blocks.join(answers.join(more, "block", "left"), "block", "left").mapInArrow(finish, out)
    nameless = rows.where("doc_id is null").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast(spans).alias("spans"), F.coalesce("text", F.lit("")).cast("binary").alias("kept"), "carried")
    return cleaned.union(nameless)
