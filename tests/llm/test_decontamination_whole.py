"""op2 and the pipeline's stage against every alignment, and copies of short items with substitutions."""

from __future__ import annotations

import random
import re
import time
from itertools import combinations

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from threadloom.llm import decontaminate, queries


def token_lists(rows):
    return [(i, re.findall(r"[^\W_]+", (text or "").lower())) for i, text in rows if i is not None]


def contaminated(docs, items):
    """{(doc_id, item_id)}: some 13 tokens in a row, or the whole shorter item, have 0.8 equal ones at some distance."""
    known: dict[str, int] = {}
    code = lambda words: np.array([known.setdefault(x, len(known)) for x in words], np.int64)
    items = [(i, code(t)) for i, t in token_lists(items) if t]
    found = set()
    for d, t in token_lists(docs):
        doc = code(t)
        for i, item in items:
            least = min(13, len(item))
            if len(doc) < least:
                continue
            padded = np.concatenate([np.full(len(item), -1), doc, np.full(len(item), -1)])
            equal = np.lib.stride_tricks.sliding_window_view(padded, len(item)) == item
            total = np.concatenate([np.zeros((len(equal), 1), np.int64), np.cumsum(equal, axis=1)], axis=1)
            if (10 * (total[:, least:] - total[:, :-least]) >= 8 * least).any():
                found.add((d, i))
    return found


def table(small, name, key):
    t = pq.read_table(f"{small}/{name}.parquet", columns=[key, "text"])
    return list(zip(t[key].to_pylist(), t["text"].to_pylist(), strict=True))


@pytest.mark.parametrize("n", range(5, 13))
def test_short_masks_tolerate_all_substitutions(n):
    changed = (2 * n) // 10
    for gone in combinations(range(n), changed):
        assert any(all(x == "0" for i, x in enumerate(m) if i in gone) for m in decontaminate.short_masks(n)), gone


@pytest.mark.parametrize("sent", [8_000_000, 0])
def test_short_items(spark, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", sent)
    items, docs = [], []
    for n in range(1, 13):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for extra in (0, 1):
            for gone in combinations(range(n), (2 * n) // 10 + extra):
                docs.append((len(docs), " ".join(["before", *("changed" if k in gone else w for k, w in enumerate(words)), "after"])))
    out = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = contaminated(docs, items)
    assert len(want) == 4 + 5 + 6 + 7 + 8 + 9 + 45 + 55 + 66 and {(r["doc_id"], r["item_id"]) for r in out.collect()} == want


def test_op2(spark, small):
    want = contaminated(table(small, "documents", "doc_id"), table(small, "benchmark", "item_id"))
    assert want and {(r["doc_id"], r["item_id"]) for r in queries.op2_spaced_seed_decontamination(spark, small).collect()} == want


def test_a_large_benchmark_is_joined(spark, small, monkeypatch):
    """The join gives the very rows that sending the benchmark gives, for texts of equal words as well."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    docs = docs.union(spark.createDataFrame([(-1, "a b " * 300), (-2, "same " * 900), (-3, None), (None, "same " * 40)], docs.schema))
    docs = docs.union(docs.where("doc_id = -2"))
    bench = bench.select("item_id", "text").union(spark.createDataFrame([(-1, "same " * 60), (-2, "b a " * 30), (-3, None), (-4, "")], "item_id long, text string"))
    want = sorted(tuple(r) for r in decontaminate.find_contamination(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", 0)
    assert want and sorted(tuple(r) for r in decontaminate.find_contamination(docs, bench).collect()) == want
    assert decontaminate.find_contamination(docs, bench.where("false")).count() == 0


def test_equal_words_cost_no_pairs(spark):
    docs = pa.array(["same " * 20_000])
    known = decontaminate.index([1], ["same " * 400])
    began = time.process_time()
    found = decontaminate._matches([7], decontaminate.tokens(docs), known)
    assert found == [(7, 1, 400, 400, 1.0, 0, 400)] and time.process_time() - began < 10


@pytest.mark.parametrize("period", [1, 2, 7])
def test_words_with_a_period_cost_no_pairs(period):
    """As many hits as alignments, whatever the period; a long text takes seconds."""
    words = [f"w{i}" for i in range(period)]
    known = decontaminate.index([1], [" ".join((words * 400)[:400])])
    docs = pa.array([" ".join((words * 60_000)[:60_000])])
    began = time.process_time()
    found = decontaminate._matches([7], decontaminate.tokens(docs), known)
    assert found == [(7, 1, 400, 400, 1.0, 0, 400)] and time.process_time() - began < 20


@pytest.mark.parametrize("sent", [8_000_000, 0])
def test_periodic_and_very_short_items(spark, monkeypatch, sent):
    """Random texts of few words and of periods, items of any length, against every alignment."""
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", sent)
    draw = random.Random(9)

    def text(most):
        words = [draw.choice("abcdef") for _ in range(draw.randrange(1, 6))]
        return " ".join(draw.choice("abcxyz") if draw.random() < 0.1 else words[i % len(words)] for i in range(draw.randrange(most)))

    docs = [(i, text(120)) for i in range(60)] + [(100, "a"), (101, "")]
    items = [(i, text(40)) for i in range(25)] + [(30, "x y z"), (31, "q"), (32, "z"), (33, "?")]
    out = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = contaminated(docs, items)
    assert len(want) > 50 and {(r["doc_id"], r["item_id"]) for r in out.collect()} == want


def test_pipeline_stage(spark, small):
    docs = table(small, "documents", "doc_id")
    gone = {d for d, _ in contaminated(docs, table(small, "benchmark", "item_id"))}
    left = corpus_pipeline.decontamination(spark, spark.read.parquet(f"{small}/documents.parquet"), small)
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - gone
