"""Encoding of many whole texts with a public tokenizer, each different word once.

Both vocabularies split a text before their merges run, and a cut at a single space between two other characters is
always such a split, and so is the one between a Latin letter or digit and ASCII punctuation that ends its segment. The
segments between those cuts can be encoded apart, and since most segments of a corpus occur again and again, each task
keeps the ids of those it has seen. Texts in which such a cut could be wrong are encoded whole.

Special tokens in a text are special tokens, as the tokenizers library takes them by default.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from threadloom.llm.text import cache_for

#: Segments, and ids of segments, that a worker keeps; at either number it starts anew.
KEPT_SEGMENTS, KEPT_IDS = 1_500_000, 12_000_000
#: Longer segments are encoded each time.
LONGEST_KEPT = 64

#: White space beside a space or a space at an end; or the mark that the cuts are made with.
_SPACE = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD_SPACE = rf"\A | \z|{_SPACE} | {_SPACE}|\x00"
#: The end of a stem and ASCII punctuation up to the end of its segment. The letters are those up to U+024F whose lower
#: case is one letter, so not U+0130.
_STEM_END = r"([0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}])([!-/:-@\[-`{-~]+)(%s|\z)"

_made: dict[tuple[str, bool], "PieceEncoder"] = {}


class _Known:
    """Segments by number, and the ids of all numbered segments in one array."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.n = 0

    def full(self) -> bool:
        return len(self.number) > KEPT_SEGMENTS or self.n and self.ends[self.n - 1] > KEPT_IDS

    def add(self, names: list[str], encoded: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        used = int(self.ends[self.n - 1]) if self.n else 0
        total = used + int(sizes.sum())
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(total, np.uint32)])
        if self.n + len(names) > len(self.ends):
            self.ends = np.concatenate([self.ends[: self.n], np.zeros(self.n + len(names), np.int64)])
        self.ids[used:total] = np.fromiter(chain.from_iterable(encoded), np.uint32, total - used)
        self.ends[self.n : self.n + len(names)] = used + np.cumsum(sizes)
        self.number.update(zip(names, range(self.n, self.n + len(names)), strict=True))
        self.n += len(names)


class PieceEncoder:
    """Ids of whole texts. ``spaced``: a segment's leading space belongs to it."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        self.owner = f"tokens {path}"
        special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.odd = "|".join(x for x in (f"(?i:{special})" if special else "", _ODD_SPACE if spaced else "") if x) or r"\x00\x00"

    @classmethod
    def of(cls, path: str, spaced: bool) -> "PieceEncoder":
        """One for each worker process and vocabulary file."""
        if (path, spaced) not in _made:
            _made[path, spaced] = cls(path, spaced)
        return _made[path, spaced]

    @classmethod
    def for_words(cls, path: str | None = None) -> "PieceEncoder":
        """The vocabulary with word ends, where white space is dropped and case makes no difference."""
        return cls.of(path or public_tokenizers.path("word_bpe_49k.json"), False)

    @classmethod
    def for_bytes(cls, path: str | None = None) -> "PieceEncoder":
        """The byte-level vocabulary, where a space leads the word after it."""
        return cls.of(path or public_tokenizers.path("byte_bpe_50k.json"), True)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Each text as a list of segments, and which texts can't be cut so and have none."""
        odd = pc.match_substring_regex(texts, self.odd)
        texts = pc.if_else(odd, "", texts)
        if self.spaced:
            marked = pc.replace_substring_regex(pc.replace_substring(texts, " ", "\0 "), _STEM_END % r"\x00", r"\1" + "\0" + r"\2\3")
            return pc.split_pattern(marked, "\0"), odd.to_numpy(zero_copy_only=False)
        # a combining mark can join a small letter where it doesn't join the capital
        lower = pc.if_else(pc.match_substring_regex(texts, r"\p{M}"), texts, pc.ascii_lower(texts))
        marked = pc.replace_substring_regex(pc.replace_substring(lower, "\n", " "), _STEM_END % " ", r"\1 \2\3")
        return pc.split_pattern(marked, " "), odd.to_numpy(zero_copy_only=False)

    def _numbers(self, names: list[str], known: _Known) -> np.ndarray:
        number = known.number
        new = [x for x in names if x not in number]
        for i in range(0, len(new), 20_000):
            known.add(new[i : i + 20_000], self._encoded(new[i : i + 20_000]))
        at = np.fromiter(map(number.__getitem__, names), np.int64, len(names))
        for x in new:
            if len(x) > LONGEST_KEPT:
                del number[x]
        return at

    def encode(self, texts: pa.Array, end_id: int | None = None) -> list[np.ndarray]:
        """The ids of each whole text (uint32), with ``end_id`` after them if there is one; a null text has none of its own."""
        texts = texts.cast(pa.large_string()).fill_null("")
        cut, odd = self._segments(texts)
        kept = cache_for(self.owner)
        if "known" not in kept or kept["known"].full():
            kept["known"] = _Known()
        known = kept["known"]
        coded = cut.flatten().dictionary_encode()
        seg = self._numbers(coded.dictionary.to_pylist(), known)[coded.indices.to_numpy()]
        stop = known.ends[seg]
        begin = np.where(seg > 0, known.ends[seg - 1], 0)
        total = np.cumsum(stop - begin)
        n = int(total[-1]) if len(total) else 0
        ids = known.ids[np.repeat(stop - total, stop - begin) + np.arange(n)]
        bounds = np.concatenate([[0], total])[cut.offsets.to_numpy()]
        last = np.zeros(0 if end_id is None else 1, np.uint32) + np.uint32(end_id or 0)
        out = [np.concatenate([ids[a:b], last]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
        whole = np.flatnonzero(odd).tolist()
        for i, x in zip(whole, self._encoded([texts[i].as_py() for i in whole]), strict=True):
            out[i] = np.concatenate([np.array(x, np.uint32), last])
        return out
