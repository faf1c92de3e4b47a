"""Each operator against a plain version, and on odd tables: nulls, empty texts, repeated rows, no rows, clashing names."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute import components, crc, near_duplicates, repeats, vector_links
from tokenizers import Tokenizer

from threadloom.llm import chat, components as spark_components, decontaminate, embeddings, html, language, minhash, packing, queries, repeats as repeat_removal, sharding, tokenfiles

DOC = "doc_id long, text string"


def docs_of(small):
    t = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def words(rng, n, kinds=300):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_docs():
    """Null, empty, blank, short, equal, near equal, very long and non-ASCII texts."""
    rng = random.Random(3)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, base), (7, base), (8, " ".join(near)), (9, words(rng, 30000)), (10, "äöü ßß 日本語 " * 20), (11, "äöü ßß 日本語 " * 20), (12, words(rng, 50))]


def test_sharding(spark):
    rows = [(i, None if i % 7 == 0 else f"t{i % 3}", i, "x") for i in range(1000)] + [(None, None, 0, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, slot long, Shard string").repartition(7)
    out = sharding.shuffle_into_shards(df, 24).toPandas()
    assert len(out) == 1005 and set(out.columns) == {"doc_id", "text", "shard", "slot"}
    sizes = out.groupby("shard").size()
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    assert Counter(out["doc_id"].dropna().astype(int)) == Counter(range(1000))
    assert sharding.shuffle_into_shards(df.where("false"), 3).count() == 0


def test_communication_matrix_is_hypergeometric(spark):
    counts = spark.createDataFrame([(0, 40), (1, 0), (2, 60), (4, 20)], "pid int, n long")
    total = np.zeros(3)
    for seed in range(8):
        m = {r["pid"]: r["sends"] for r in sharding.communication_matrix(counts, 5, 120, 3, seed).collect()}
        assert {k: sum(v) for k, v in m.items()} == {0: 40, 2: 60, 4: 20}
        assert [sum(v[s] for v in m.values()) for s in range(3)] == [40, 40, 40]
        total += m[0]
    assert np.all(np.abs(total / 8 - 40 / 3) < 4)


def test_op1(spark, small):
    out = queries.op1_hypergeometric_sharding(spark, small).toPandas()
    docs = docs_of(small)
    assert len(out) == len(docs) and set(out["law"]) == {"rows"} and out["grown_shard"].isna().all()
    assert all(r.size == r["size"] or r["size"] == len((docs[r.doc_id] or "").encode()) + 8 for _, r in out.iterrows())
    assert all(r.text_crc32 == zlib.crc32((docs[r.doc_id] or "").encode()) for r in out.itertuples())


def test_decontamination(spark):
    rng = random.Random(4)
    item = words(rng, 40, 5000).split()
    other = words(rng, 8, 5000)
    changed = item[5:25]
    changed[3], changed[15] = "sub", "stituted"
    rows = [
        (1, words(rng, 30) + " " + " ".join(item[3:30]).upper().replace(" ", ", ")), (2, words(rng, 20) + " " + " ".join(changed) + " " + words(rng, 10)),
        (3, words(rng, 400, 5000)), (4, None), (5, ""), (6, other), (7, words(rng, 5) + " " + other + " " + words(rng, 5)), (8, " ".join(item[:9])), (None, " ".join(item)), (1, "clean words only"),
    ]
    docs = spark.createDataFrame(rows, DOC)
    bench = spark.createDataFrame([(10, " ".join(item)), (11, other), (12, None), (13, "too short"), (11, other), (None, "x")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_contamination(docs, bench).collect()}
    assert set(found) == {(1, 10), (2, 10), (6, 11), (7, 11)}
    best = found[1, 10]  # the longest stretch with enough equal tokens reaches over the 27 equal ones
    assert best["n_equal"] == 27 and best["start_token"] <= 30 and best["start_token"] + best["n_tokens"] >= 57 and best["share"] >= 0.8 and found[2, 10]["n_equal"] == 18
    left = decontaminate.decontaminate(docs.withColumn("item_id", docs["doc_id"]), bench)
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 3, 4, 5, 8] and left.columns == ["doc_id", "text", "item_id"]
    assert decontaminate.decontaminate(docs, bench.where("false")).count() == 10 and decontaminate.find_contamination(docs.where("false"), bench).count() == 0


@pytest.mark.parametrize("gap", range(13))
def test_masks_tolerate_two_substitutions(gap):
    """Wherever two of 13 tokens are changed (one at the edge), a mask has a clean place."""
    for second in range(13):
        clean = [i not in (gap, second) for i in range(13)]
        assert any(all(clean[at + j] for j, x in enumerate(m) if x == "1") for m in decontaminate.MASKS for at in range(13 - len(m) + 1)), (gap, second)


def check_repeats(spark, docs):
    df = spark.createDataFrame(docs, DOC)
    out = repeat_removal.remove_repeats(df).selectExpr("doc_id", "n_bytes", "n_removed", "size(spans) n_spans", "sha2(kept, 256) s").collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in out} == repeats(dict(docs))


def test_repeats_odd(spark, odd_docs):
    check_repeats(spark, odd_docs)


def test_repeats_random(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abc ") for _ in range(rng.randrange(30, 140))) for _ in range(25)]
    docs = [(i * 3, "".join(rng.choice(pool) if rng.random() < 0.7 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(90))) for _ in range(rng.randrange(0, 12)))) for i in range(150)]
    docs += [(1000 + i, "z" * rng.randrange(40, 200)) for i in range(20)] + [(2000 + i, "ab" * 300 + str(i)) for i in range(10)]
    old = repeat_removal.BLOCK_BYTES
    check_repeats(spark, docs)
    try:
        repeat_removal.BLOCK_BYTES = 3000
        check_repeats(spark, docs)
    finally:
        repeat_removal.BLOCK_BYTES = old


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_repeated_ids(spark, seed):
    """Rows that share a doc_id, also a larger one, lose what rows of smaller doc_ids have and nothing else."""
    draw = random.Random(seed)
    part = ["".join(draw.choices("abcdefgh", k=120)) for _ in range(6)]
    rows = [(draw.choice([1, 5, 5, 5, 7, 9, 9]), "".join(draw.choice(part)[: draw.choice([30, 60, 120])] for _ in range(draw.randrange(1, 6)))) for _ in range(40)]
    rows += [(1, part[0]), (5, "A" * 60 + part[0] + "B" * 55), (5, "A" * 60 + part[0] + "B" * 55)]
    want = []
    for doc, text in rows:
        known = {t[i : i + 50] for d, t in rows if d < doc for i in range(len(t) - 49)}
        gone = [False] * len(text)
        for i in range(len(text) - 49):
            if text[i : i + 50] in known:
                gone[i : i + 50] = [True] * 50
        want.append((doc, len(text), sum(gone), "".join(c for c, g in zip(text, gone, strict=True) if not g).encode()))
    out = repeat_removal.remove_repeats(spark.createDataFrame(rows, DOC).repartition(3)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in out) == sorted(want)


def test_repeats_edges(spark):
    text = "q" * 10 + words(random.Random(1), 40)
    df = spark.createDataFrame([(1, text, 0), (1, text, 1), (None, text, 2), (2, text, 3)], DOC + ", kept int")
    out = {(r["doc_id"], r["n_removed"]) for r in repeat_removal.remove_repeats(df).collect()}
    assert out == {(1, 0), (None, 0), (2, len(text))}
    assert repeat_removal.remove_repeats(df.where("false")).count() == 0


def test_op3(spark, small):
    out = {r["doc_id"]: tuple(r)[1:] for r in queries.op3_radix_repeat_removal(spark, small).collect()}
    assert out == repeats(docs_of(small))


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(200 + i, (base[i % 50] + rng.normal(size=24) * 0.2).tolist()) for i in range(150)] + [(400 + i, base[3].tolist()) for i in range(40)]
    rows += [(500, None), (501, [0.0] * 24), (502, [float("nan")] + [1.0] * 23), (503, [None] + [1.0] * 23), (504, [float("inf")] * 24), (505, []), (506, [1e-200] * 24), (507, [1e200] * 24), (508, [1.0, 2.0]), (509, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicate_vectors(df, 0.9).collect()}
    assert out == vector_links(dict(rows) | {506: [1.0] * 24, 507: [1.0] * 24}, 0.9)
    assert embeddings.near_duplicate_vectors(df.where("false")).count() == 0
    bad = embeddings.near_duplicate_vectors(df.where("vec_id between 500 and 505").withColumn("n_links", df["vec_id"])).collect()
    assert {(r["vec_id"], r["n_links"], r["kept"]) for r in bad} == {(i, 0, True) for i in range(500, 506)}


def test_op4(spark, small):
    t = pq.read_table(f"{small}/embeddings.parquet", columns=["vec_id", "embedding"])
    want = vector_links(dict(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True)), 0.9)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op4_pivot_permutation_near_dedup(spark, small).collect()}
    assert got.keys() == want.keys() and sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())


def test_long_lists_are_split(spark, monkeypatch):
    """With any length of lists and blocks, the links are those of the plain version."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.6])).tolist()) for i in range(400)]
    df, want = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), vector_links(dict(rows), 0.9)
    for long, block in ((2048, 512), (20, 8), (0, 3)):
        monkeypatch.setattr(embeddings, "LONG", long)
        monkeypatch.setattr(embeddings, "BLOCK", block)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicate_vectors(df, 0.9).collect()}
        assert sum(n for n, _ in want.values()) > 1000 and sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


@pytest.mark.parametrize("n", [5_000, 40_000])
def test_recall_of_links_just_above_the_threshold(spark, n):
    """Planted pairs at cosine 0.90 to 0.92 among unlike vectors, as in a table that big."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(500, 64))
    y -= (y * x[:500]).sum(1, keepdims=True) * x[:500]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(0.9001, 0.92, (500, 1))
    near = c * x[:500] + np.sqrt(1 - c * c) * y
    table = pa.table({"vec_id": np.arange(n + 500), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([x, near]).ravel()), 64).cast(pa.list_(pa.float64()))})
    out = embeddings.near_duplicate_vectors(spark.createDataFrame(table), 0.9).where("vec_id >= " + str(n)).collect()
    assert len(out) == 500 and sum(r["component_id"] == r["vec_id"] - n for r in out) >= 0.98 * 500


def check_packing(rows, docs, capacity=2048):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by, seqs = defaultdict(dict), defaultdict(list)
    for r in rows:
        by[r["doc_id"]][r["piece"]] = r
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for d, text in docs.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        assert len(by[d]) == -(-len(ids) // capacity)
        for k, r in by[d].items():
            part = ids[k * capacity : (k + 1) * capacity]
            assert (r["start"], r["length"], r["ids_crc32"]) == (k * capacity, len(part), crc(part)), d
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs), total


def test_packing(spark, odd_docs):
    rows = packing.pack(packing.tokenized_pieces(spark.createDataFrame(odd_docs, DOC))).collect()
    check_packing(rows, dict(odd_docs))
    assert packing.pack(packing.tokenized_pieces(spark.createDataFrame([], DOC))).count() == 0


def test_packing_keeps_columns_of_any_name(spark):
    rows = spark.range(300).selectExpr("id as _tag", "cast(1 + id % 90 as int) as length", "id * 2 as _u", "'b' as _block", "id as `_rank`", "array(id) as row", "1 as `a.b`", "7 as offset")
    out = packing.pack(rows, 100)
    assert out.columns == ["_tag", "length", "_u", "_block", "_rank", "row", "a.b", "sequence_id", "offset"] and dict(out.dtypes)["length"] == "int"
    got = out.collect()
    assert sorted(r["_tag"] for r in got) == list(range(300)) and all((r["_u"], r["_block"], r["_rank"], r["row"], r["length"]) == (2 * r["_tag"], "b", r["_tag"], [r["_tag"]], 1 + r["_tag"] % 90) for r in got)
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 300


def test_packing_keeps_other_columns_and_ranks_in_blocks(spark):
    rng = random.Random(2)
    rows = [(rng.choice([5, 300, 1024, 1025, 2048, 700]), i, "x") for i in range(500)]
    old = packing.RANK_ROWS
    try:
        packing.RANK_ROWS = 20
        out = packing.pack(spark.createDataFrame(rows, "length long, offset long, sequence_id string").withColumnRenamed("offset", "own")).collect()
    finally:
        packing.RANK_ROWS = old
    assert sorted(r["own"] for r in out) == list(range(500))
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in seqs.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(seqs) <= 1.03 * sum(r[0] for r in rows) / 2048 + 60


def test_op5(spark, small):
    n, total = check_packing(queries.op5_configuration_lp_packing(spark, small).collect(), docs_of(small))
    assert n <= 1.02 * total / 2048 + 2


def check_near(spark, docs, per_cent):
    df = spark.createDataFrame(list(docs.items()), DOC)
    out = minhash.near_duplicates(df, per_cent / 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == near_duplicates(docs, per_cent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_near_duplicates(spark, odd_docs):
    rng = random.Random(6)
    docs = dict(odd_docs)
    base = words(rng, 200).split()
    for i in range(60):  # a chain: each differs from the one before in one more word
        base = list(base)
        base[rng.randrange(200)] = f"new{i}"
        docs[100 + i] = " ".join(base)
    for i in range(60):
        docs[300 + i] = words(rng, rng.randrange(1, 12), 4)
    check_near(spark, docs, 85)
    check_near(spark, docs, 80)


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 2), (None, "a b c d e f", 3), (2, "a b c d e f", 4), (3, None, 5), (4, None, 6)], DOC + ", kept int")
    out = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert out == {(1, 1, True): 2, (None, None, True): 1, (2, 1, False): 1, (3, 3, True): 1, (4, 4, True): 1}
    left = minhash.deduplicate(df)
    assert left.columns == df.columns and Counter(r["doc_id"] for r in left.collect()) == {1: 1, None: 1, 3: 1, 4: 1}
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_op6(spark, small):
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op6_superminhash_near_dedup(spark, small).collect()}
    assert out == near_duplicates(docs_of(small), 85)


def test_superminhash_estimates(spark):
    rng = np.random.default_rng(3)
    err = []
    for n, share in [(8, 4), (40, 30), (300, 150), (3000, 2400)] * 8:
        x = rng.integers(0, 1 << 63, 2 * n - share).astype(np.uint64)
        sig = minhash.superminhash(np.concatenate([x[:n], x[n - share :]]), np.array([0, n, 2 * n]), 120)
        err.append((sig[0] == sig[1]).mean() - share / (2 * n - share))
    assert abs(np.mean(err)) < 0.02 and np.abs(err).max() < 0.17


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(150)]
    nodes = {x for e in links for x in e if e[0] != e[1]}
    got = {r["node"]: r["root"] for r in spark_components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == components(nodes, links)


def bytes_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def check_tokens(rows, docs):
    start = 0
    got = {r[0]: tuple(r)[1:] for r in rows}
    for d in sorted(docs):
        ids = bytes_ids(docs[d])
        assert got[d] == (start, len(ids), crc(ids)), d
        start += len(ids)


def test_op7(spark, small):
    check_tokens(queries.op7_dictionary_token_files(spark, small).collect(), docs_of(small))


def test_token_files(spark, odd_docs, tmp_path):
    docs = [*odd_docs, (13, "a <|endoftext|> b"), (14, "  two  spaces \n\n x "), (15, " lead"), (16, "trail "), (-(1 << 63), "least"), (None, "nameless")]
    folder = f"file://{tmp_path}/t"
    manifest = tokenfiles.write_token_files(spark.createDataFrame(docs, DOC).withColumn("part", tokenfiles.F.lit("x")), folder)
    rows = tokenfiles.read_token_files(spark, manifest, folder).collect()
    assert [(r["start"], r["n_tokens"]) for r in rows if r["doc_id"] is None] == [(0, len(bytes_ids("nameless")))]
    ahead = len(bytes_ids("nameless"))
    check_tokens([(r["doc_id"], r["start"] - ahead, *tuple(r)[2:]) for r in rows], dict(docs[:-1]))
    r = manifest.first()
    f = tokenfiles.TokenFile(r["path"], tokenfiles.load_dictionary(folder, r["dictionary"], r["width"]))
    assert f.nameless == 1 and f.find(-(1 << 63)).tolist() == bytes_ids("least")
    assert f.find(12).tolist() == bytes_ids(dict(docs)[12])
    with pytest.raises(KeyError):
        f.find(999)
    empty = tokenfiles.write_token_files(spark.createDataFrame([], DOC), folder + "2")
    assert tokenfiles.read_token_files(spark, empty, folder + "2").count() == 0


def test_chat(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "more")]
    rows = [(1, i, *t) for i, t in enumerate(turns[:1])] + [(2, i, *t) for i, t in enumerate(turns)] + [(3, i, *t) for i, t in enumerate(turns)] + [(4, 0, "user", "other <|im_end|>")]
    rows += [(5, 5, None, None), (6, 0, "user", ""), (None, 0, "user", "hi"), (7, 1, "user", "hi"), (7, 1, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", chat.F.lit(1))
    out = {r["conv_id"]: r for r in chat.render_chats(df).collect()}
    assert set(out) == {2, 4, 5, 6, 7}
    assert out[2]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert out[4]["rendered"] == "<|im_start|>user\nother <im_end><|im_end|>\n" and out[5]["rendered"] == "<|im_start|>unknown\n<|im_end|>\n" and out[7]["n_turns"] == 2
    assert chat.render_chats(df.where("false")).count() == 0


def test_html(spark):
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a>menu</a></nav><div class='cookie-notice'>We use cookies</div><article><header>By X</header><h1>Head &amp; line</h1><p>One\n two<br>three <b>bold</b>.<form>f</form><p>&lt;tag&gt; caf&eacute;</article><aside>side</aside><section id=comments><p>nice!</section><footer>&copy; x</footer>"
    plain = "<body><p>{} words here stand alone on this page {}<p>Shared line of the template<p>Another shared line</body>"
    rows = [(1, "http://a.com/x/1", page), (2, "http://a.com/x/2", None), (3, None, ""), (4, "http://b.com/p/1", plain.format("First " * 20, 1)), (5, "http://b.com/p/2", plain.format("Second " * 20, 2)), (6, "not a url", "text only"), (6, "not a url", "text only")]
    out = defaultdict(list)
    for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", html.F.lit("x"))).collect():
        out[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert out[1][0] == "By X Head & line One two three bold. <tag> café" or out[1][0] == "Head & line One two three bold. <tag> café"
    assert out[2] == [""] and out[3] == [""] and out[6] == ["text only"] * 2
    assert out[4] == [f"{'First ' * 20} words here stand alone on this page 1".replace("  ", " ")] and "Shared" not in out[5][0]
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p class='ad'>Buy<p>Real one<p>Real two</article>", "Real one Real two"),
        ("<article><p>A sentence <span class=ad>Buy</span> goes on.<div class='related-work'><p>Section</div><div class='related posts'>no</div></article>", "A sentence goes on. Section"),
        ("<article><ul><li class=ad>one<li>two<ul><li>inner</ul><li>three</ul></article>", "two inner three"),
        ("<article><div class=ad>never closed<p>x</article><footer>f<p>g</footer>", ""),
        ("<article><table><tr><td class=ad>a<td>b<tr><td>c</table></article>", "b c"),
        ("<article><p>a<!-- <p>b --><script>if (a < b) '</p>'</script><style>p{}</style> c</article>", "a c"),
        ("<main><div hidden><p>no</div><p style='display: none'>no</p><p>yes &lt;b&gt; &#233;</main>", "yes <b> é"),
        ("<article><nav>menu<article>inside", ""),
        ("text <", "text <"), ("<p>" * 3 + "x" * 500_000, "x" * 500_000),
    ],
)
def test_html_of_odd_pages(page, want):
    assert html.main_text(html.lines_of(page), []) == want


def test_common_lines():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        at = html.common_lines(a, b)
        it = iter(b)
        assert len(at) == best[-1, -1] and all(a[i] in it for i in at) and at == sorted(at)


def test_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = queries.op10_rank_order_language(spark, small)
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert out.count() == docs.count() and len(rows) > 20 and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    profiles = language.learn_profiles(docs)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "123 !?", "c"), (4, "the", "d"), (4, "the", "d")], DOC + ", Lang_Pred string")
    said = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(odd, profiles).collect()]
    assert [x for x in said if x[0] < 4] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)] and said[3] == said[4] and said[3][1] != "und"
    assert language.identify(odd.where("false"), profiles).count() == 0
    nothing = language.learn_profiles(docs.where("false"))
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}
