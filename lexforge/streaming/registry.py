"""A near-duplicate gate over a stream whose registry of fingerprints lives across micro-batches and restarts.

The registry is a table of segment values: a row of a batch looks up what lies within a bit of its own segments, in the parts of
the table that hold these values, and in its own batch. Equal prints of a batch are one before they meet anything. Everything that
a batch writes lies in folders of its number, and it reads only those of smaller numbers; so a batch that breaks off and is run
again finds and leaves the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators.dedup import near_earlier, segment_keys, segments
from lexforge.plans.tables import delete, exists, materialize

#: Parts of the registry, by segment values: a small batch reads few of them.
PARTS = 64
ROWS = "id long, fp long, registers boolean"


def _keyed(prints: DataFrame, distance: int, near: bool) -> DataFrame:
    """(fp, path, key, part)."""
    cut = segments(range(64), distance)
    return prints.select("fp", F.inline(segment_keys(cut, 1, near))).withColumn("part", F.pmod(F.col("key"), F.lit(PARTS)).cast("int"))


def admit(batch: DataFrame, number: int, folder: str, distance: int) -> None:
    """Judge the rows (id, fp, registers) of a batch: one is a near duplicate if a row that registers came before it, in an earlier
    batch or with a smaller id in this one, within ``distance``. Zero is no fingerprint."""
    spark = batch.sparkSession
    rows = materialize(batch.select("id", "fp", "registers").where("fp <> 0"))
    prints = materialize(rows.groupBy("fp").agg(F.bool_or("registers").alias("registers")))
    registry, known = f"{folder}/registry", None
    earlier = [n for n in range(number) if exists(spark, f"{registry}/batch={n}/_SUCCESS")]
    if earlier:
        probes = materialize(_keyed(prints, distance, near=True))
        touched = [r["part"] for r in probes.select("part").distinct().collect()]
        table = spark.read.option("basePath", registry).parquet(*[f"{registry}/batch={n}" for n in earlier])
        table = table.where(F.col("part").isin(touched)).select("path", "key", F.col("fp").alias("other"))
        away = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
        known = materialize(probes.join(table, ["path", "key"]).where(away <= distance).groupBy("fp").agg(F.min(away).alias("away")))
    new = prints.where("registers").select("fp")
    if known is not None:
        new = new.join(known.where("away = 0"), "fp", "left_anti")
    _keyed(new, distance, near=False).write.mode("overwrite").partitionBy("part").parquet(f"{registry}/batch={number}")
    lost = near_earlier(rows, distance).select("id")
    if known is not None:
        lost = lost.unionByName(rows.join(known, "fp", "left_semi").select("id"))
    lost.distinct().write.mode("overwrite").parquet(f"{folder}/losers/batch={number}")


def run(spark: SparkSession, source: str, folder: str, distance: int = 2, files: int = 1000) -> None:
    """All files of ``source`` that are new since the last run, in micro-batches of so many at most."""
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda batch, number: admit(batch, number, folder, distance))
    writer.option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()


def losers(spark: SparkSession, folder: str) -> DataFrame:
    """(id) of all near duplicates so far."""
    return spark.read.schema("id long, batch int").parquet(f"{folder}/losers").select("id")


def forget(spark: SparkSession, folder: str) -> None:
    """Begin a new session: the registry and what it found go, and a stream begins anew."""
    delete(spark, folder)
