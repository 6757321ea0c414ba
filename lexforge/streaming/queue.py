"""A work queue over the rows of a table: workers claim what is pending, for a time, and complete it or say that it failed.

States are a table that is merged on read: a claim or an outcome writes its own rows only. A claim that is not ended in its time is
pending again, so rows of a worker that was lost go to another one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.streaming.merge_table import MergeTable

LINE = "id long, state string, worker string, until timestamp, number long"


@dataclass(frozen=True)
class Queue:
    """One caller changes the queue at a time, as with any table that has one log."""

    folder: str

    def _table(self) -> MergeTable:
        return MergeTable(f"{self.folder}/states", "id", "state", "number")

    def states(self, spark: SparkSession) -> DataFrame:
        """(id, state, worker, until, number) of all rows that were ever claimed."""
        table = self._table()
        return table.read(spark) if table.last(spark) >= 0 else spark.createDataFrame([], LINE)

    def _write(self, rows: DataFrame, state: str, worker: str, until: Column) -> None:
        table, number = self._table(), self._table().last(rows.sparkSession) + 1
        table.put(rows.select("id", F.lit(state).alias("state"), F.lit(worker).alias("worker"), until.cast("timestamp").alias("until"), F.lit(number).cast("long").alias("number")), number)

    def pending(self, items: DataFrame, now: Column) -> DataFrame:
        """(id) of the rows of (id) that nobody has ended or holds."""
        held = self.states(items.sparkSession).where((F.col("state") != "claimed") | (F.col("until") > now)).select("id")
        return items.select("id").distinct().join(held, "id", "left_anti")

    def claim(self, items: DataFrame, worker: str, most: int, now: Column, seconds: int) -> DataFrame:
        """(id) of up to ``most`` pending rows of the smallest ids, which are the worker's for some seconds."""
        spark = items.sparkSession
        taken = self.pending(items, now).orderBy("id").limit(most)
        self._write(taken, "claimed", worker, now.cast("timestamp") + F.make_dt_interval(secs=F.lit(seconds)))
        number = self._table().last(spark)
        return self.states(spark).where(F.col("number") == number).select("id")

    def end(self, rows: DataFrame, worker: str, outcome: str = "completed") -> int:
        """Say how rows of (id) ended. Only those count that the worker still holds; their number."""
        spark = rows.sparkSession
        own = self.states(spark).where((F.col("state") == "claimed") & (F.col("worker") == worker)).select("id")
        self._write(rows.select("id").distinct().join(own, "id", "left_semi"), outcome, worker, F.lit(None))
        number = self._table().last(spark)
        return self.states(spark).where(F.col("number") == number).count()
