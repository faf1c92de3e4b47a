"""The pipeline's stages on planted cases, and the registered SQL."""

from __future__ import annotations

import random

import corpus_pipeline
import duckdb
from threadloom.llm import queries


def test_stages_in_order(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "repeat_removal", "decontamination", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.count() <= docs.count()
        docs = out
    assert docs.count() > 0


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small).toPandas()
    assert len(out) and not out.duplicated(["doc_id", "piece"]).any()
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048


def test_stage_decisions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    item = spark.read.parquet(f"{small}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    clean = " ".join(f"clean{random.Random(i).random()}" for i in range(80))
    extra = spark.createDataFrame([(900001, clean), (900002, "1234 5678"), (900003, None), (900004, f"{clean[:200]} {item} {clean[200:]}")], "doc_id long, text string")
    rows = extra.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars").select(*docs.columns)
    both = docs.union(rows)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, both, small).select("doc_id").collect()}
    assert 900002 not in kept and 900003 not in kept and {r["doc_id"] for r in docs.where("text rlike '[a-z]{3}'").select("doc_id").collect()} <= kept
    left = {r["doc_id"] for r in corpus_pipeline.decontamination(spark, rows, small).select("doc_id").collect()}
    assert 900004 not in left and 900001 in left


def test_sql_agrees(spark, small):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, small)
        want = con.sql(sql)
        at = [want.columns.index(c) for c in got.columns]
        assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall()), name
