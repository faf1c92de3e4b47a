"""The registered queries of this subpackage: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.chat import render_chats
from threadloom.llm.decontaminate import find_contamination
from threadloom.llm.embeddings import near_duplicate_vectors
from threadloom.llm.html import extract_pages
from threadloom.llm.language import identify, learn_profiles
from threadloom.llm.minhash import near_duplicates
from threadloom.llm.negatives import mine_negatives
from threadloom.llm.packing import pack, tokenized_pieces
from threadloom.llm.quality import featured, learn_from, score_features
from threadloom.llm.repeats import remove_repeats
from threadloom.llm.resample import resample
from threadloom.llm.sharding import shuffle_into_shards
from threadloom.llm.storage import materialize, scratch_path
from threadloom.llm.tokenfiles import read_token_files, write_token_files

N_SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the ``rows`` law. A null text has size 8 and the crc32 of no bytes."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffle_into_shards(rows, N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_dictionary_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as token files and read back."""
    folder = scratch_path(spark, "tokens")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, manifest, folder)


def op9_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op8_snapshot_collapse_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations, rendered."""
    return render_chats(table(spark, sf_dir, "conversations"))


def op10_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; those with crc32(doc_id) mod 4 = 2 are held out of the learning."""
    docs = table(spark, sf_dir, "documents")
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0))
    profiles = learn_profiles(docs.where(part != 2))
    out = identify(docs.select("doc_id", (part == 2).alias("held_out"), "text"), profiles)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, with the best passage for each item."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_radix_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that a document with a smaller doc_id also has."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_pivot_permutation_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings at cosine 0.9."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op5_configuration_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenized, cut and packed into sequences of 2048 tokens."""
    out = pack(tokenized_pieces(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents at similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), 0.85)


def op11_batch_concatenation_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents with 20 words or more, drawn towards the benchmark by importance."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_l2ap_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings whose vec_id is divisible by 50, among all embeddings."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = mine_negatives(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; those with crc32(doc_id) mod 4 = 2 are held out of the learning."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0))
    rows = materialize(featured(docs), "features")
    ranking = learn_from(rows, labels.where(part != 2).select("doc_id", F.col("quality").alias("label")))
    out = score_features(rows, ranking)
    return out.select("doc_id", (part == 2).alias("held_out"), "score", "predicted")


OP8_SQL = """
WITH turns AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
               FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
firsts AS (SELECT turns, min(conv_id) AS conv_id FROM turns GROUP BY turns),
prefixes AS (SELECT DISTINCT turns[1:i] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS i FROM turns)),
kept AS (SELECT * FROM firsts WHERE NOT EXISTS (SELECT 1 FROM prefixes WHERE prefixes.turns = firsts.turns)),
said AS (SELECT conv_id, len(turns) AS n_turns, array_to_string(list_transform(turns, lambda x: '<|im_start|>'
           || replace(replace(coalesce(x.r, 'unknown'), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || chr(10)
           || replace(replace(coalesce(x.t, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || '<|im_end|>' || chr(10)), '') AS rendered FROM kept)
SELECT conv_id, n_turns, length(rendered) AS n_chars, rendered FROM said
"""

OP11_SQL = r"""
WITH RECURSIVE table_of(i, n, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, n + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM table_of WHERE n < 8),
steps AS (SELECT list(c ORDER BY i) AS step FROM table_of WHERE n = 8),
said AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
asked AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
of_docs AS (SELECT row, unnest(words) AS word FROM said),
vocabulary AS (SELECT word FROM of_docs UNION SELECT word FROM asked),
coded AS (SELECT word, hex(encode(word)) AS code FROM vocabulary),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(code) // 2 + 1),
             lambda k: ('0x' || substr(code, (2 * k - 1)::INT, 2))::BIGINT)), lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
           FROM coded, steps),
mine AS (SELECT bucket, count(*) AS s FROM of_docs JOIN hashed USING (word) GROUP BY bucket),
theirs AS (SELECT bucket, count(*) AS t FROM asked JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM of_docs) AS all_s, (SELECT count(*) FROM asked) AS all_t),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
          FROM (SELECT bucket FROM mine UNION SELECT bucket FROM theirs) LEFT JOIN mine USING (bucket) LEFT JOIN theirs USING (bucket), totals),
weights AS (SELECT row, sum(gain)::BIGINT AS weight FROM of_docs JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
             + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM said LEFT JOIN weights USING (row)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM placed
"""

OP12_SQL = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
              FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
          FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hypergeometric_sharding": op1_hypergeometric_sharding,
    "op10_rank_order_language": op10_rank_order_language,
    "op11_batch_concatenation_resampling": op11_batch_concatenation_resampling,
    "op12_l2ap_hard_negatives": op12_l2ap_hard_negatives,
    "op13_bradley_terry_quality": op13_bradley_terry_quality,
    "op2_spaced_seed_decontamination": op2_spaced_seed_decontamination,
    "op3_radix_repeat_removal": op3_radix_repeat_removal,
    "op4_pivot_permutation_near_dedup": op4_pivot_permutation_near_dedup,
    "op5_configuration_lp_packing": op5_configuration_lp_packing,
    "op6_superminhash_near_dedup": op6_superminhash_near_dedup,
    "op7_dictionary_token_files": op7_dictionary_token_files,
    "op9_page_differencing": op9_page_differencing,
    "op8_snapshot_collapse_chat": op8_snapshot_collapse_chat,
}
ORACLE_SQL: dict[str, str] = {"op8_snapshot_collapse_chat": OP8_SQL, "op11_batch_concatenation_resampling": OP11_SQL, "op12_l2ap_hard_negatives": OP12_SQL}
