"""The stages of the training-data pipeline. Each takes (spark, docs, sf_dir) and works on all rows that it gets.

Rows, in every stage: a null text is the empty one; rows with a null id are rows like any other; repeated rows are each judged
(and are one in ``drop_near_duplicates``); an empty table gives an empty table; columns that are not asked for are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import packing, quality, similar, suffix, toxicity
from lexforge.llm.labelled import fold
from lexforge.llm.queries import tokenizer_path
from lexforge.plans.tables import load, materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the operator's threshold."""
    model = toxicity.train(docs, load(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return docs.where(toxicity.score(F.col("text"), model) < toxicity.THRESHOLD)


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the operator's threshold."""
    model = quality.train(docs, load(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return docs.where(quality.score(F.col("text"), model) >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts (Jaccard of five-word shingles 0.8 or more) one row: of the smallest id, rows
    without an id last, then of the smallest digest of the whole row; of equal rows one."""
    key = "_row_key"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    keyed = docs.withColumn(key, F.md5(F.to_json(F.struct(*docs.columns)).cast("binary")))
    groups = similar.similar_groups(keyed, ["doc_id", key])
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", key)).alias("m"))
    stay = keyed.join(materialize(best.select(f"m.{key}")), key, "left_semi")
    # rows of one key are equal: any of them stands for all
    return stay.groupBy(key).agg(F.first(F.struct(*docs.columns)).alias("r")).select("r.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that it repeats from itself or others. A code point that loses a byte goes
    whole; n_chars follows the text."""
    others = [c for c in docs.columns if c != "text"]
    kept = suffix.remove_repeats(docs, carry=others, points=True)
    found = kept.select("doc_id.*", F.col("kept").cast("string").alias("text"))
    if "n_chars" in others:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return packing.pack(docs, tokenizer_path())
