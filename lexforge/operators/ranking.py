"""Gapless ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Split of every group: the rows of one group are numbered in so many independent runs.
SALTS = 256


def rank_in_groups(df: DataFrame, group: str, key: Column, rank: str = "rank", salts: int = SALTS) -> DataFrame:
    """Number the rows of each ``group`` gaplessly from 0, in the order of (salt of ``key``, ``key``).

    A plain ``row_number() over (partition by group)`` sends a group to one task. Here a group is cut by a hash of
    ``key`` into ``salts`` runs, each numbered on its own; the runs' sizes (groups x salts rows) are summed up to
    give each run its offset. Rows that tie on ``key`` are interchangeable."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    runs = salted.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(F.col(group).alias("_g"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(group, "_salt").orderBy(key)
    numbered = salted.withColumn("_own", F.row_number().over(own) - 1)
    joined = numbered.join(offsets, (F.col(group) == F.col("_g")) & (F.col("_salt") == F.col("_s")))
    return joined.withColumn(rank, (F.col("_before") + F.col("_own")).cast("long")).drop("_salt", "_own", "_g", "_s", "_before")
