"""Resampling, hard negatives and quality against plain versions, on the driver's tables and on odd ones."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from threadloom.llm import negatives, quality, queries
from threadloom.llm.negatives import mine_negatives
from threadloom.llm.quality import learn_ranking, score_quality
from threadloom.llm.resample import resample


def table(folder, name):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]+", lambda m: m.group().lower(), (text or "").encode()))


def resampled(docs, target, percent=10, least_words=20, most=1, buckets=10_000, seed=2024):
    """Sorted (doc_id, n_features, weight, score, rank) of [(doc_id, text)]."""

    def buckets_of(text):
        w = words_of(text)
        return [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in buckets_of(x)), Counter(b for x in target for b in buckets_of(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for d, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets_of(x))
        rows.append([d, len(buckets_of(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    able = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_op11(spark, small):
    got = sorted((tuple(r) for r in queries.op11_batch_concatenation_resampling(spark, small).collect()), key=repr)
    assert got == resampled([(r["doc_id"], r["text"]) for r in table(small, "documents")], [r["text"] for r in table(small, "benchmark")])
    assert any(r[4] for r in got)


def test_resampling_odd_rows(spark):
    draw = random.Random(3)
    said = ["", None, "\x00\x00", "Ä ä É é", "x" * 70_000, "a " * 20_000, "a\x00b A B 12c-d", "İstanbul K"]
    docs = [(draw.choice([None, 1, 2, i]), draw.choice([*said, " ".join(draw.choices("the of And and to_in é9 q".split(), k=30))])) for i in range(150)]
    target = ["the of and", None, "", "q q q"]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, rank int").repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for most in (1, 3):
        out = resample(df, wanted, percent=33, least_words=3, most=most, buckets=97)
        got = sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
        assert got == resampled(docs, target, 33, 3, most, 97)
    assert resample(df.where("false"), wanted).collect() == []
    assert all(r["rank"] is None for r in resample(df, wanted.where("false"), percent=0).collect())


def negatives_of(rows, anchors, positives=5, k=3, low=50, high=95):
    """Sorted result rows of [(vec_id, label, vector)]; ``anchors`` says of a vec_id whether it is one."""

    def sound(r):
        return r[0] is not None and r[1] is not None and r[2] is not None and all(c is not None and math.isfinite(c) for c in r[2])

    rows = [(i, label, [math.floor(256 * c) for c in v]) for i, label, v in rows if sound((i, label, v))]
    out = []
    for n, (i, label, v) in enumerate(rows):
        if not anchors(i):
            continue
        scored = [(-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -LONG), LONG), j, other) for m, (j, other, w) in enumerate(rows) if m != n and len(w) == len(v)]
        for p, pos, _ in sorted((s, j, o) for s, j, o in scored if o == label)[:positives]:
            inside = sorted((s, j) for s, j, o in scored if o != label and low * -p <= 100 * -s <= high * -p)[:k]
            out += [(i, pos, rank + 1, j, -p, -s) for rank, (s, j) in enumerate(inside)]
    return sorted(out)


LONG = (1 << 63) - 1
NEGATIVES = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"


def test_op12(spark, small):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in table(small, "embeddings")]
    got = sorted(tuple(r[c] for c in NEGATIVES) for r in queries.op12_l2ap_hard_negatives(spark, small).collect())
    assert got and got == negatives_of(rows, lambda i: i % 50 == 0)


def test_negatives_odd_rows(spark, monkeypatch):
    draw = random.Random(5)

    def vector(dim):
        return [draw.gauss(0, 1) for _ in range(dim)]

    hot = vector(40)
    rows = [(i, draw.randrange(4), [c + draw.gauss(0, 0.3) for c in hot]) for i in range(150)]
    rows += [(200 + i, draw.randrange(3), hot) for i in range(120)]  # one vector of very many rows
    rows += [(draw.randrange(30) * 5, 9, vector(40)) for _ in range(20)]  # repeated vec_ids
    rows += [(500 + i, i % 2, vector(3)) for i in range(12)] + [(600 + i, i % 2, []) for i in range(6)]
    rows += [(700, 1, [1e200, 1.0, -1.0]), (705, 0, [1e-9, 2.0, 3.0]), (710, None, hot), (715, 1, None), (None, 1, hot)]
    rows += [(720, 1, [None] + hot[1:]), (725, 1, [float("nan")] + hot[1:]), (730, 1, [float("inf")] + hot[1:]), (735, 77, vector(40)), (740, 1, [0.0] * 40)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label long, embedding array<double>, row int, dim int").repartition(3)

    def got(df):
        return sorted(tuple(r[c] for c in NEGATIVES) for r in mine_negatives(df, F.col("vec_id") % 5 == 0).collect())

    want = negatives_of(rows, lambda i: i % 5 == 0)
    here = got(df)
    assert sorted(set(here) ^ set(want))[:5] == [] and here == want
    # many blocks; the settings are read on the driver and, in groups, by the workers' own module
    monkeypatch.setattr(negatives, "ROW_COMPONENTS", 40 * 60)
    monkeypatch.setattr(negatives, "ANCHOR_COMPONENTS", 40 * 25)
    assert got(df) == want
    assert got(df.where("false")) == [] and mine_negatives(df, F.lit(False)).collect() == []


def test_search_finds_all_pairs_and_leaves_dimensions_out():
    draw = np.random.default_rng(2)
    x, q = np.floor(256 * draw.normal(size=(500, 70)) * np.linspace(2, 0.1, 70)), np.floor(256 * draw.normal(size=(20, 70)))
    scores = q @ x.T
    for share in (0.999, 0.9, 0.2):
        least = np.quantile(scores, share, axis=1)
        near, far, score = negatives.Index(x).search(q, least)
        assert set(zip(near.tolist(), far.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(scores >= least[:, None])), strict=True))
        assert (score == scores[near, far]).all()


def test_op13_on_held_out_rows(spark, small):
    """All rows are scored, and those held out agree with their labels."""
    label = {r["doc_id"]: r["quality"] for r in table(small, "labels")}
    rows = queries.op13_bradley_terry_quality(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in table(small, "documents"))
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(label[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert sum(a == b for a, b in held) >= 0.9 * len(held) > 0


def test_ranking_is_by_pairs():
    """The gradient's direction: every step is taken for preferences, and good rows end above bad ones."""
    import pyarrow as pa

    texts = pa.array([f"some words of text number {i} are here" for i in range(60)] + [f"SOME### words{i}&&& OF!! text*** |" for i in range(20)])
    label = np.array([1] * 60 + [0] * 20)
    ranking = quality.fit(quality.features(texts), label)
    s = ranking.scores(quality.features(texts))
    assert s[:60].min() >= quality.THRESHOLD > s[60:].max()
    one = quality.features(pa.array(["SOME### words&&&", "", None, "a b"]))
    assert one.at[-1] == len(one.column) and quality.fit(one, np.ones(4)).scores(one).min() >= quality.THRESHOLD


def test_quality_odd_rows(spark):
    good = [(i, f"plain words in a row {i}") for i in range(40)]
    bad = [(100 + i, f"JUNK!! JUNK!! {i}### |") for i in range(20)]
    odd = [(None, "x"), (1, None), (1, ""), (7, " \n\t"), (8, "é" * 200_000), (9, "| " * 200_000), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in good + bad + odd], "doc_id long, text string, score double, predicted int").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (3, None), (4, 7), (999, 1)], "doc_id long, label int")
    out = score_quality(docs, learn_ranking(docs, labels)).collect()
    assert len(out) == len(good + bad + odd) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == 1 for r in out if r["doc_id"] in range(10, 40)) and all(r["predicted"] == 0 for r in out if (r["doc_id"] or 0) >= 100)
    for none in (labels.where("false"), labels.where("label = 1")):
        assert all(r["predicted"] == 1 for r in score_quality(docs, learn_ranking(docs, none)).collect())
    assert all(r["predicted"] == 0 for r in score_quality(docs, learn_ranking(docs, labels.where("label = 0"))).collect())
    assert score_quality(docs.where("false"), learn_ranking(docs.where("false"), labels)).collect() == []


def slope_of_all_pairs(x, label, w):
    """The slope of the mean loss over every pair, one by one."""
    s = np.array([sum(x.value[i:j] * w[x.column[i:j]]) for i, j in zip(x.at, x.at[1:])])
    good, bad, pull = np.flatnonzero(label == 1), np.flatnonzero(label == 0), np.zeros(len(label))
    for g in good:
        p = 1 / (1 + np.exp(s[g] - s[bad])) / len(good) / len(bad)
        pull[g] -= p.sum()
        pull[bad] += p
    return x.transposed_times(pull) + quality.RIDGE * w, s


def test_ranking_is_learned_from_all_rows_and_all_pairs(spark):
    """More rows of each label than were once drawn, labels that features don't tell apart fully, and repeated doc_ids."""
    import pyarrow as pa

    draw = random.Random(11)
    rows = []
    for i in range(10_500):
        label = int(i % 21 < 11)
        words = ["plain", "Words", "of!!", "###", "12", "x-1", "ROW"]
        rows.append((i, label, " ".join(draw.choices(words, [9, 3, 1 + 2 * (1 - label), 2 - label, 1, 1, 1], k=draw.randrange(1, 30)))))
    docs = spark.createDataFrame([(i, t) for i, _, t in rows] + [(3, "a second row of 3")], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, k) for i, k, _ in rows] + [(7, 0)], "doc_id long, label int")
    seen = [(k, t) for _, k, t in rows] + [(rows[3][1], "a second row of 3"), (0, rows[7][2])]
    x, label = quality.features(pa.array([t for _, t in seen])), np.array([k for k, _ in seen])
    assert min(np.bincount(label)) > 4_900
    got = learn_ranking(docs, labels)
    slope, s = slope_of_all_pairs(x, label, got.weights)
    assert np.linalg.norm(slope) < 1e-6
    s, n = np.sort(s), int((label == 0).sum())
    assert abs(got.quantile - (s[n - 1] + s[n]) / 2) < 1e-12 and abs(got.scale - 2 / s.std()) < 1e-9
    alone = quality.fit(x, label)
    # with this ridge, so far at most are weights with flat slopes from the only ones without any
    assert np.linalg.norm(alone.weights - got.weights) <= 2 * quality.FLAT / quality.RIDGE


def test_ranks_of_strengths_are_exact():
    import pyarrow as pa

    texts = [f"Word{'!' * (i % 7)} {'ROW ' * (i % 5)}{'x-1 ' * (i % 3)}" for i in range(400)]
    x, label, w = quality.features(pa.array(texts)), np.arange(400) % 2, np.random.default_rng(1).normal(size=quality.WIDTH)
    s = np.sort(x.times(w))
    assert s[0] < 0 < s[-1]
    assert quality._ranked(lambda of, width: of(x, label), w, [0, 57, 200, 201, 399]) == s[[0, 57, 200, 201, 399]].tolist()


def test_equal_texts_have_equal_scores():
    import pyarrow as pa

    text = "Some words, OF!! a text 12 and x-1 more; twice twice"
    texts = pa.array([t for i in range(300) for t in (text, f"other {'Words! ' * (i % 9)}{i}")])
    w = np.random.default_rng(2).normal(size=quality.WIDTH)
    assert len(set(quality.features(texts).times(w)[::2].tolist())) == 1
