"""4. Sharding by rendezvous hashing of stable record keys.

Every shard draws a number from (key, shard) alone and the largest weighted number takes the record, so a further shard
takes records only into itself, and a shard of twice the weight takes twice the records. Only built-in functions run.

Rows: a null key is a key like any other; repeated rows land in the same shard, each with its own slot; a null text has
no bytes; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.operators.ranking import rank_in_groups
from lexforge.plans.tables import materialize


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: each shard's draw u in (0, 1) is scored as weight / -ln(u)."""
    draws = []
    for shard, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
        draws.append(F.struct((F.lit(float(weight)) / -F.ln(u)).alias("score"), F.lit(shard).alias("shard")))
    return F.array_max(F.array(*draws))["shard"]


def shard(docs: DataFrame, shards: int = 16, weights: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): slots are gapless from 0 in each shard; grown_shard is
    the shard with one more of weight 1. Texts are not moved, only these columns are."""
    weights = list(weights or [1.0] * shards)
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(id_col).cast("long"), weights).alias("shard"),
        shard_of(F.col(id_col).cast("long"), [*weights, 1.0]).alias("grown_shard"),
    )
    slotted = rank_in_groups(materialize(placed), "shard", F.col("doc_id"), rank="slot")
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
