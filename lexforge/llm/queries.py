"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import bpe, clusters, mixing, oracles, packing, quality, repair, rules, sharding, simhash, sketch, suffix, topk, toxicity
from lexforge.plans.tables import load

#: File of the tokenizer that the packed and encoded ids belong to.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(load(spark, sf_dir, "documents"), tokenizer_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=3)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_path())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(load(spark, sf_dir, "documents"), shards=16)


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix.remove_repeats(load(spark, sf_dir, "documents"), span=200)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.held_out_scores(load(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(load(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(load(spark, sf_dir, "conversations"), damage=repair.damaged)


def op13_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_and_next(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op5_suffix": op5_suffix,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_topk": op8_topk,
    "op9_quality": op9_quality,
    "op10_rules": op10_rules,
    "op11_clusters": op11_clusters,
    "op12_repair": op12_repair,
    "op13_sketch": op13_sketch,
}

ORACLE_SQL: dict[str, str] = {
    "op8_topk": """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op11_clusters": oracles.clusters_sql(),
    "op12_repair": oracles.repair_sql(),
}
