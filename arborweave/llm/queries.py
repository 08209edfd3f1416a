"""Queries of the pipeline operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweave.llm import fingerprint, langid, mixing, packing, pii, quality, secrets, sharding, simhash, topk

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(read(spark, sf_dir, "documents"))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_positions(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", *[F.try_element_at("placements", F.lit(i))["position"].alias(f"position_{i}") for i in (1, 2)])


def op4_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op6_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(read(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(read(spark, sf_dir, "documents"))


def op8_ngram_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.predicted_languages(docs, langid.train(docs))


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {f.__name__: f for f in (op1_phrase_fingerprints, op2_simhash_components, op3_curriculum_mix, op4_threshold_top_k, op5_compression_quality, op6_kd_tree_shards, op7_entropy_secrets, op8_ngram_language, op9_feistel_pseudonyms, op10_best_fit_packing)}

#: Hashes, trained models, tokenizers and trees are beyond SQL; those queries are tested against plain definitions.
ORACLE_SQL: dict[str, str] = {
    "op4_threshold_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
