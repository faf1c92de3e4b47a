"""op10 and the whole pipeline against plain versions, and every stage on odd tables."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from brute import crc, language, language_profiles, near_duplicates, without_repeats
from test_decontamination_whole import contaminated, table
from tokenizers import Tokenizer

from threadloom.llm import queries


def documents(small):
    t = pq.read_table(f"{small}/documents.parquet")
    return {r["doc_id"]: r for r in t.to_pylist()}


def test_op10(spark, small):
    docs = documents(small)
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in docs}
    profiles = language_profiles((r["lang"], r["text"]) for d, r in docs.items() if not held[d])
    got = {r["doc_id"]: r for r in queries.op10_rank_order_language(spark, small).collect()}
    assert got.keys() == docs.keys()
    for d, r in docs.items():
        lang, score = language(r["text"], profiles)
        assert (got[d]["held_out"], got[d]["lang_pred"]) == (held[d], lang) and abs(got[d]["score"] - score) < 1e-9, d


def test_pipeline(spark, small):
    """The rows of run() are the pieces of the texts that plain versions of the first four stages leave."""
    docs = documents(small)
    profiles = language_profiles((r["lang"], r["text"]) for r in docs.values())
    texts = {}
    for d, r in docs.items():
        lang, score = language(r["text"], profiles)
        if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE:
            texts[d] = r["text"]
    texts = {d: texts[d] for d, (_, root) in near_duplicates(texts, 80).items() if root == d}
    left = {}
    for d, (_, removed, _, kept) in without_repeats(texts).items():
        text = texts[d] if not removed else kept.decode("utf-8", "replace").replace("\ufffd", "")
        if not removed or not re.fullmatch(r"[ \t\n\x0b\f\r]*", text):
            left[d] = text
    gone = {d for d, _ in contaminated(left.items(), table(small, "benchmark", "item_id"))}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for d in left.keys() - gone:
        ids = tokenizer.encode(left[d], add_special_tokens=False).ids + [0]
        want |= {(d, k, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048])) for k, s in enumerate(range(0, len(ids), 2048))}
    rows = corpus_pipeline.run(spark, small).collect()
    assert want and {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.fixture(scope="module")
def odd(spark):
    text = "A plain sentence that stands in several rows and is long enough to have shingles, words and repeats of its own in it."
    rows = [
        (1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "t", 2), (3, None, None, None, None), (4, "", "en", "s", 0), (None, text, "en", "s", 5), (5, " \t\n", "de", "s", 3),
        (6, "x " * 200_000, "en", "s", 400_000), (7, "Ein Satz der anders ist und in einer anderen Sprache steht, mit genug Worten für alles.", "de", "s", 9), (8, text + " More of it \U0001f600 follows here.", "en", "s", 7),
    ]
    clash = "kept string, component_id string, lang_pred string, score string, n_removed string, carried string, _text string, block string, mark string, sequence_id string, offset string, length string"
    df = spark.createDataFrame([(*r, *"abcdefghijkl") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + clash)
    return df.union(df.where("doc_id = 7"))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, small, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, small)
    rows = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {None, *range(1, 9)} and all(0 < r["length"] <= 2048 for r in rows)
        assert stage(spark, odd.where("false"), small).count() == 0
        return
    assert out.columns == odd.columns and all(tuple(r)[5:] == tuple("abcdefghijkl") for r in rows)
    ids = sorted((r["doc_id"] for r in rows if r["doc_id"] is not None))
    want = {
        "language_id": [1, 1, 2, 6, 7, 7, 8], "near_dedup": [1, 3, 4, 5, 6, 7, 8],
        "repeat_removal": [1, 1, 3, 4, 5, 6, 7, 7, 8], "decontamination": [1, 1, 2, 3, 4, 5, 6, 7, 7, 8],
    }[name]
    assert [i for i in ids if name != "language_id" or i != 6] == [i for i in want if name != "language_id" or i != 6]
    assert (None in {r["doc_id"] for r in rows}) or name == "language_id"
    assert stage(spark, odd.where("false"), small).count() == 0
