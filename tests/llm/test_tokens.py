"""The encoder against the tokenizers library, over all of Unicode."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from threadloom.llm import tokens

ASCII = [chr(i) for i in range(32, 127)]
#: Letters whose case changes their number of characters, combining marks, kinds of white space, apostrophes.
ODD = [*"İıßſKÅΣςǰẖ'’´`", "\u0331", "\u0301", "\u0307", "\u030c", "\u0308", "\n", "\t", "\u3000", "\u2009", "\u200b", "\x85", "\x1c", *" " * 20]


def _character(rng):
    kind = rng.random()
    if kind < 0.45:
        return rng.choice(ASCII)
    if kind < 0.65:
        return rng.choice(ODD)
    if kind < 0.85:
        return chr(rng.randrange(1, 0x24F))
    code = rng.randrange(0x3000) if kind < 0.93 else rng.randrange(0x110000)
    return chr(code) if not 0xD800 <= code < 0xE000 else "x"


@pytest.mark.parametrize("which", ["for_words", "for_bytes"])
def test_ids_are_the_library_s(which):
    encoder, rng = getattr(tokens.PieceEncoder, which)(), random.Random(7)
    texts = ["".join(_character(rng) for _ in range(rng.randrange(60))) for _ in range(6000)]
    texts += [x + rng.choice(["<|endoftext|>", "<|ENDOFTEXT|>", " <|startoftext|> ", "<|endoftext|>."]) + x[:9] for x in texts[:600]]
    texts += ["İ.", "İ. İ", "aİ'", "J\u030c.", "I\u0307.", "x's'.", "don't. Don'T!", "a" * 5000 + ".", "end.\n\nnew", "", None]
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        want = encoder.tokenizer.encode_batch_fast([x or "" for x in part], add_special_tokens=False)
        for x, got, w in zip(part, encoder.encode(pa.array(part, pa.string()), 9), want, strict=True):
            assert got.tolist() == [*w.ids, 9], repr(x)


def test_a_full_cache_starts_anew(monkeypatch):
    encoder = tokens.PieceEncoder.for_words()
    monkeypatch.setattr(tokens, "KEPT_SEGMENTS", 3)
    for x in ("one two three four five", "six seven", "one six"):
        assert encoder.encode(pa.array([x]))[0].tolist() == encoder.tokenizer.encode(x, add_special_tokens=False).ids
