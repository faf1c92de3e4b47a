"""Five cleaning stages over ``documents``, each one operator of threadloom.llm.

All stages but the last return the columns of documents; each works on all rows that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.decontaminate import decontaminate
from threadloom.llm.language import UNKNOWN, identify, learn_profiles
from threadloom.llm.minhash import deduplicate
from threadloom.llm.packing import pack, tokenized_pieces
from threadloom.llm.repeats import remove_repeats
from threadloom.llm.storage import drop_path, scratch_path

#: A text less like every learned language than this is in none of them.
LEAST_LANGUAGE_SCORE = 0.25
#: Similarity from which documents are near duplicates.
LEAST_SIMILARITY = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the labelled languages; ``lang`` becomes the predicted one."""
    # columns of the documents may have any name, also those that the operator adds
    own = {c: f"_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang")}
    said = identify(docs.withColumnsRenamed(own), learn_profiles(docs))
    kept = said.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*[F.col("lang_pred" if c == "lang" else own.get(c, c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near duplicates."""
    return deduplicate(docs, LEAST_SIMILARITY)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings out of texts that a document with a smaller doc_id also has; drop texts of which nothing
    but white space is left. Bytes of a character that a cut has split go as well."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = remove_repeats(docs, others)
    left = F.col("kept").cast("string")
    cut = F.coalesce(F.try_validate_utf8(left), F.replace(F.make_valid_utf8(left), F.lit("\ufffd"), F.lit("")))
    text = F.when(F.col("carried.null_text"), F.lit(None)).when(F.col("n_removed") == 0, left).otherwise(cut)
    rows = out.select("doc_id", "n_removed", "carried", text.alias("_text")).where(F.col("_text").isNull() | (F.col("n_removed") == 0) | ~F.col("_text").rlike(r"^\s*$"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("_text").cast("long"))
    own = {"doc_id": F.col("doc_id"), "text": F.col("_text"), **{c: F.col(f"carried.`{c}`") for c in others}}
    if "n_chars" in own:
        own["n_chars"] = F.coalesce(n_chars, own["n_chars"].cast("long"))
    return rows.select(*[own[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack what is left."""
    return pack(tokenized_pieces(docs))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The signatures, the suffix sort and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
