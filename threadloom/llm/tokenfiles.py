"""Token-id files: each document one zstandard frame, all frames under one shared dictionary.

Layout of a file: header (magic, id width, SHA-256 of the dictionary), the frames in ascending doc_id order, an
index of three int64 columns (doc_id, end of its frame, number of ids), and a footer (number of documents, how many of
them, from the first on, have no doc_id, where the index begins, magic). One document is read with its frame and the index alone. Short documents share their
statistics through the dictionary, which is trained on serialized id arrays and lies beside the files.

Files are written by the tasks that hold the documents, under names that no other attempt uses; only a manifest of
what finished tasks wrote says which files count, so lost executors and repeated tasks leave no wrong file in use.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.storage import materialize
from threadloom.llm.text import pieces
from threadloom.llm.tokens import PieceEncoder

MAGIC = b"TLTOKEN1"
_HEAD, _FOOT = "<8sI32s", "<qqq8s"
#: Closes every document.
END_ID = 2
#: The dictionary is trained on about so many documents, of each at most so many characters.
SAMPLE_DOCS, SAMPLE_CHARS = 2_000, 20_000
DICTIONARY_BYTES = 64_000
#: Text that goes into one file, in bytes.
FILE_TEXT_BYTES = 32_000_000
#: Frames that a reader takes in at once, in bytes.
READ_BYTES = 8_000_000


class Dictionary(NamedTuple):
    data: bytes
    width: int  # bytes of an id

    @property
    def digest(self) -> bytes:
        return hashlib.sha256(self.data).digest()

    def _loaded(self) -> dict:
        return {"dict_data": zstandard.ZstdCompressionDict(self.data)} if self.data else {}

    def compressor(self) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=3, **self._loaded())

    def decompressor(self) -> zstandard.ZstdDecompressor:
        return zstandard.ZstdDecompressor(**self._loaded())


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _narrow(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, n: int, tokenizer: str | None = None) -> Dictionary:
    """A dictionary from a bounded sample of the ``n`` documents, drawn by a hash of doc_id; empty if they are too few."""
    u = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    sample = docs.where(u * n < SAMPLE_DOCS).select(F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS).alias("text"), u.alias("u")).orderBy("u").limit(2 * SAMPLE_DOCS).collect()
    encoder = PieceEncoder.for_bytes(tokenizer)
    width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4
    arrays = [_narrow(x, width) for x in encoder.encode(pa.array([r["text"] for r in sample], pa.string()))]
    try:
        data = zstandard.train_dictionary(DICTIONARY_BYTES, [x for x in arrays if x]).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples
        data = b""
    return Dictionary(data, width)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Write all documents (doc_id, text) to ``folder``; returns the manifest, a row for each file.

    Manifest: part, path, dictionary (hex of its SHA-256), width, n_docs, n_tokens. Documents are in ascending doc_id order
    (then by text) over all files in order of part; nulls come first. A null text is empty and holds only the end id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    dictionary = train_dictionary(rows, n, tokenizer)
    system, base = _open(folder)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/dictionary-{dictionary.digest.hex()}.zdict") as f:
        f.write(dictionary.data)
    sent = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, d = PieceEncoder.for_bytes(tokenizer), sent.value
        system, base = _open(folder)
        name, out, part = f"tokens-{uuid.uuid4().hex}.tok", None, 0
        ids: list[int | None] = []
        ends: list[int] = []
        counts: list[int] = []
        at, zip_ = 0, d.compressor()
        try:
            for batch in batches:
                for piece in pieces(batch, "text"):
                    if out is None:
                        out, part = system.open_output_stream(f"{base}/{name}"), piece["part"][0].as_py()
                        out.write(struct.pack(_HEAD, MAGIC, d.width, d.digest))
                        at = struct.calcsize(_HEAD)
                    ids += piece["doc_id"].to_pylist()
                    for x in encoder.encode(piece["text"], END_ID):
                        frame = zip_.compress(_narrow(x, d.width))
                        out.write(frame)
                        at += len(frame)
                        ends.append(at)
                        counts.append(len(x))
            if out is not None:
                named = [x for x in ids if x is not None]
                out.write(np.array([[0] * (len(ids) - len(named)) + named, ends, counts], "<i8").tobytes())
                out.write(struct.pack(_FOOT, len(ids), len(ids) - len(named), at, MAGIC))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "dictionary": [d.digest.hex()], "width": pa.array([d.width], pa.int32()), "n_docs": [len(ids)], "n_tokens": [sum(counts)]})

    ranges = max(1, ceil(size / FILE_TEXT_BYTES))
    ordered = rows.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    return materialize(ordered.mapInArrow(write, "part int, path string, dictionary string, width int, n_docs long, n_tokens long"), "manifest")


class TokenFile:
    """One file, open for reading."""

    def __init__(self, path: str, dictionary: Dictionary):
        system, name = _open(path)
        self.file = system.open_input_file(name)
        magic, self.width, digest = struct.unpack(_HEAD, self.file.read_at(struct.calcsize(_HEAD), 0))
        if magic != MAGIC or digest != dictionary.digest:
            raise ValueError(f"{path} is no token file of this dictionary")
        size = self.file.size()
        n, self.nameless, begin, _ = struct.unpack(_FOOT, self.file.read_at(struct.calcsize(_FOOT), size - struct.calcsize(_FOOT)))
        index = np.frombuffer(self.file.read_at(24 * n, begin), "<i8").reshape(3, n)
        self.ids, self.ends, self.counts = index
        self.begins = np.concatenate([[struct.calcsize(_HEAD)], self.ends[:-1]])
        self.unzip = dictionary.decompressor()

    def _ids(self, frame: bytes, n: int) -> np.ndarray:
        return np.frombuffer(self.unzip.decompress(frame, max_output_size=self.width * int(n)), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, from its frame alone."""
        return self._ids(self.file.read_at(int(self.ends[i] - self.begins[i]), int(self.begins[i])), self.counts[i])

    def find(self, doc_id: int) -> np.ndarray:
        """The ids of a document by doc_id."""
        i = self.nameless + int(np.searchsorted(self.ids[self.nameless :], doc_id))
        if i == len(self.ids) or self.ids[i] != doc_id:
            raise KeyError(doc_id)
        return self.document(i)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, a bounded stretch of the file at a time."""
        i = 0
        while i < len(self.ids):
            j = max(i + 1, int(np.searchsorted(self.ends, self.begins[i] + READ_BYTES, "right")))
            data = memoryview(self.file.read_at(int(self.ends[j - 1] - self.begins[i]), int(self.begins[i])))
            for k in range(i, j):
                yield None if k < self.nameless else int(self.ids[k]), self._ids(bytes(data[self.begins[k] - self.begins[i] : self.ends[k] - self.begins[i]]), self.counts[k])
            i = j


def load_dictionary(folder: str, digest: str, width: int) -> Dictionary:
    system, base = _open(folder)
    with system.open_input_stream(f"{base}/dictionary-{digest}.zdict") as f:
        return Dictionary(f.read(), width)


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of ``manifest``.

    ``start`` counts the ids of all documents before it; the checksum is over ids as little-endian 32-bit numbers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                start, rows = r["start"], []
                for doc, ids in TokenFile(r["path"], load_dictionary(folder, r["dictionary"], r["width"])).documents():
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # as many rows as files: their starts are summed in one small task
    before = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")
    files = manifest.withColumn("start", before)
    n = max(1, manifest.count())
    return files.repartitionById(n, F.pmod("part", F.lit(n)).cast("int")).select("path", "dictionary", "width", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
