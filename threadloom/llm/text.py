"""Words, shingles and hashes of many texts at once, on Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; arrays of eight bytes a position are made of them.
PIECE_BYTES = 2_000_000
#: White space between words: space, and the controls from tab to carriage return.
SPACES = (0x20, *range(0x09, 0x0E))

_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits (the splitmix finaliser)."""
    x = x + _U((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=_U), 1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {True: np.ones(1, _U), False: np.ones(1, _U)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the hash base (or of its inverse) modulo 2**64."""
    if len(_powers[inverse]) < n:
        base = np.full(max(n, PIECE_BYTES), _U(_INVERSE if inverse else _BASE))
        base[0] = 1
        _powers[inverse] = np.multiply.accumulate(base)
    return _powers[inverse][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with len(data) + 1 entries; the bytes [i, j) hash to (p[j] - p[i]) * base ** -i."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


_caches: dict[str, dict] = {}


def cache_for(owner: str) -> dict:
    """What this worker process keeps for ``owner`` from task to task; what it keeps for others is let go.

    A worker serves the tasks of one stage after another. Operators ask for their cache, if only to free the others',
    where a task begins, so no stage runs in what memory an earlier one has left.
    """
    for name, kept in _caches.items():
        if name != owner:
            kept.clear()
    return _caches.setdefault(owner, {})


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with up to ``limit`` bytes of text each, or one row if that is longer."""
    sizes = np.asarray(pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if len(sizes) > first:
        yield batch.slice(first)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends. A null text is empty."""
    a = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words(NamedTuple):
    hash: np.ndarray  # of the lower-cased word
    doc: np.ndarray  # index of the text it is in
    start: np.ndarray  # byte offset among the bytes of all texts
    end: np.ndarray


def words(texts: pa.Array) -> Words:
    """All words of all texts in order: runs of bytes that aren't white space, A-Z lower-cased, never across texts."""
    data, at = raw(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, _U), none, none, none)
    data = _LOWER[data]
    black = ~_IS_SPACE[data]
    first = black.copy()
    first[1:] &= ~black[:-1]
    begins = at[:-1][at[:-1] < len(data)]
    first[begins] = black[begins]
    last = black.copy()
    last[:-1] &= ~black[1:]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] = black[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    p = prefix_hash(data)
    h = mix((p[end] - p[start]) * powers(len(data), inverse=True)[start] + (end - start).astype(_U), 2)
    return Words(h, np.searchsorted(at, start, "right") - 1, start, end)


def shingles(w: Words, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of every run of ``k`` words; of texts with fewer words, one for the whole sequence."""
    n = len(w.hash)
    count = np.bincount(w.doc, minlength=n_docs)
    out_h, out_d = [], []
    if n >= k:
        h = np.zeros(n - k + 1, _U)
        for j in range(k):
            h = mix(h ^ w.hash[j : n - k + 1 + j], 3)
        whole = w.doc[: n - k + 1] == w.doc[k - 1 :]
        out_h.append(h[whole])
        out_d.append(w.doc[: n - k + 1][whole])
    first = np.cumsum(count) - count
    for m in range(1, k):
        docs = np.flatnonzero(count == m)
        if len(docs):
            h = np.zeros(len(docs), _U)
            for j in range(m):
                h = mix(h ^ w.hash[first[docs] + j], 3)
            out_h.append(mix(h, 10 + m))
            out_d.append(docs)
    if not out_h:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h, d = np.concatenate(out_h), np.concatenate(out_d)
    order = np.argsort(d, kind="stable")
    return h[order], d[order]


def distinct(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and where each text's begin and the last ends."""
    ends = np.searchsorted(doc, np.arange(n_docs + 1))
    sets = [np.unique(h[ends[i] : ends[i + 1]]) for i in range(n_docs)]
    at = np.zeros(n_docs + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=at[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), at


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, as ``distinct`` returns them."""
    h, doc = shingles(words(texts), len(texts), k)
    return distinct(h, doc, len(texts))
