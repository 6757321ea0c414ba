"""A keyed table that is merged when it is read: a base, and small deltas that later go into a new base.

A batch costs what its own rows cost: it writes the last row of each of its keys to a folder of its own and then adds a line to the
log of commits. What is not in that log is not there, so a batch that breaks off leaves nothing behind, and one that is run again
after its line was written does nothing. A reader takes the newest base and the deltas after it and applies these to each key in
their order; ``compact`` writes what a reader sees as the next base, ``vacuum`` deletes what no line needs any more.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.plans.tables import delete, exists

LOG = "kind string, number long, folder string"


@dataclass(frozen=True)
class MergeTable:
    """Rows of ``key``. A row that comes in is skipped if the stored hash is the same and the stored stamp is not older; else it
    takes the place of the stored one but for the columns of ``keep``."""

    target: str
    key: str
    hash_col: str
    stamp: str
    keep: Sequence[str] = ()

    def _commits(self, spark: SparkSession) -> list[tuple[str, int, str]]:
        """One line for each batch and base that was ever committed."""
        log = f"{self.target}/commits"
        return [tuple(r) for r in spark.read.schema(LOG).parquet(log).collect()] if exists(spark, log) else []

    def _commit(self, spark: SparkSession, kind: str, number: int, folder: str) -> None:
        spark.createDataFrame([(kind, number, folder)], LOG).coalesce(1).write.mode("append").parquet(f"{self.target}/commits")

    def _live(self, spark: SparkSession) -> tuple[tuple[int, str] | None, list[tuple[int, str]]]:
        """The newest base, with the last batch that it holds, and the deltas after it."""
        commits = self._commits(spark)
        bases = [(n, folder) for kind, n, folder in commits if kind == "base"]
        base = max(bases) if bases else None
        return base, sorted((n, folder) for kind, n, folder in commits if kind == "delta" and (base is None or n > base[0]))

    def put(self, rows: DataFrame, number: int) -> bool:
        """Add a batch; False if its number, or a later one, was committed before. Of several rows of a key the latest counts."""
        spark = rows.sparkSession
        if any(kind == "delta" and n >= number for kind, n, _ in self._commits(spark)):
            return False
        rest = [c for c in rows.columns if c != self.key]
        latest = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), self.stamp).alias("r")).select(self.key, "r.*")
        folder = f"delta-{number}-{uuid.uuid4().hex[:8]}"
        latest.write.parquet(f"{self.target}/{folder}")
        self._commit(spark, "delta", number, folder)
        return True

    def _applied(self, stored: Column, news: Column) -> Column:
        """The row after those of ``news``, in their order."""

        def step(now: Column, new: Column) -> Column:
            same = now[self.hash_col].eqNullSafe(new[self.hash_col]) & (now[self.stamp].cast("string") >= new[self.stamp].cast("string"))
            taken = new
            for name in self.keep:
                taken = taken.withField(name, now[name])
            return F.when(F.coalesce(same, F.lit(False)), now).otherwise(taken)

        # a first row of its own is compared with itself and stays
        return F.when(news.isNull(), stored).otherwise(F.aggregate(news, F.coalesce(stored, F.get(news, F.lit(0))), step))

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as of the last commit."""
        base, deltas = self._live(spark)
        if base is None and not deltas:
            raise ValueError(f"nothing was merged into {self.target}")
        stored = spark.read.parquet(f"{self.target}/{base[1]}") if base else None
        if not deltas:
            return stored
        found = [spark.read.parquet(f"{self.target}/{folder}").withColumn("_batch", F.lit(n)) for n, folder in deltas]
        columns = (stored if base else found[0]).columns
        rest = [c for c in columns if c not in (self.key, "_batch")]
        union = found[0]
        for df in found[1:]:
            union = union.unionByName(df)
        # a key has a row of each batch at most, and compaction bounds the batches
        news = union.groupBy(self.key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_batch", F.struct(*rest).alias("r")))), lambda x: x["r"]).alias("_news"))
        kind = union.select(F.struct(*rest).alias("r")).schema["r"].dataType
        if stored is None:
            joined = news.select(self.key, self._applied(F.lit(None).cast(kind), F.col("_news")).alias("_row"))
        else:
            old = stored.select(F.col(self.key).alias("_key"), F.struct(*rest).cast(kind).alias("_old"))
            both = old.join(news, F.col("_key") == F.col(self.key), "full_outer")
            joined = both.select(F.coalesce(self.key, "_key").alias(self.key), self._applied(F.col("_old"), F.col("_news")).alias("_row"))
        return joined.select(self.key, "_row.*").select([c for c in columns if c != "_batch"])

    def compact(self, spark: SparkSession) -> None:
        """Make base and deltas one new base."""
        _, deltas = self._live(spark)
        if not deltas:
            return
        number = deltas[-1][0]
        folder = f"base-{number}-{uuid.uuid4().hex[:8]}"
        self.read(spark).write.parquet(f"{self.target}/{folder}")
        self._commit(spark, "base", number, folder)

    def vacuum(self, spark: SparkSession) -> None:
        """Delete bases and deltas that the newest base has taken up; readers that began before it lose them."""
        base, deltas = self._live(spark)
        live = {folder for _, folder in [*([base] if base else []), *deltas]}
        for _, _, folder in self._commits(spark):
            if folder not in live:
                delete(spark, f"{self.target}/{folder}")

    def last(self, spark: SparkSession) -> int:
        """The number of the last batch; -1 before the first."""
        return max((n for _, n, _ in self._commits(spark)), default=-1)

    def pending(self, spark: SparkSession) -> int:
        """Deltas that a reader has to apply."""
        return len(self._live(spark)[1])
