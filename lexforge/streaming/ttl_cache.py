"""A cache with time to live, as the state of a stream of puts and gets.

Each key has its last value and when it was put, and one timer on event time that clears both when they are too old and the
watermark has passed; so the state holds what is alive only, however many keys there ever were. The answers are a table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REQUESTS = "key string, at timestamp, number long, value string"
ANSWERS = "key string, at timestamp, outcome string, value string, put_at timestamp"


HOUR = 3_600_000_000
_FOUND = "key string, at long, outcome string, value string, put_at long"


class Cache(StatefulProcessor):
    """Requests in the order of their times: one with a value puts it, one without asks. A put that is older than the stored one, or
    of its time with a smaller number, changes nothing. An entry is alive for less than ``life`` microseconds after it was put."""

    def __init__(self, life: int) -> None:
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, micros long, number long")

    def _until(self, put_at: int) -> int:
        """Milliseconds, as timers count."""
        return -(-(put_at + self.life) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        began = now = tuple(self.entry.get()) if self.entry.exists() else None
        for at, asks, number, value in sorted(((r["micros"], r["value"] is None, r["number"], r["value"]) for r in rows), key=lambda r: r[:3]):
            if not asks:
                if now is None or (at, number) > now[1:]:
                    now = (value, at, number)
                continue
            alive = now is not None and now[1] <= at < now[1] + self.life
            yield Row(key=key[0], at=at, outcome="hit" if alive else "miss", value=now[0] if alive else None, put_at=now[1] if alive else None)
        if now != began:
            if began is not None:
                self.handle.deleteTimer(self._until(began[1]))
            self.entry.update(now)
            self.handle.registerTimer(self._until(now[1]))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.entry.exists():
            value, put_at, _ = self.entry.get()
            if self._until(put_at) <= expiredTimerInfo.getExpiryTimeInMs():
                self.entry.clear()
                yield Row(key=key[0], at=put_at + self.life, outcome="expired", value=value, put_at=put_at)

    def close(self) -> None:
        pass


def answers(requests: DataFrame, hours: float, late: str = "1 hour") -> DataFrame:
    """(key, at, outcome, value, put_at) of a stream of REQUESTS: hits and misses of gets, and what expired."""
    timed = requests.withColumn("micros", F.unix_micros("at")).withWatermark("at", late)
    found = timed.groupBy("key").transformWithState(Cache(round(hours * HOUR)), _FOUND, "Append", "EventTime")
    return found.withColumns({n: F.timestamp_micros(n) for n in ("at", "put_at")})


def run(spark: SparkSession, source: str, folder: str, hours: float, files: int = 1000) -> DataFrame:
    """All answers so far, after the files of ``source`` that are new since the last run."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files).parquet(source)
        writer = answers(stream, hours).writeStream.format("parquet").option("path", f"{folder}/answers").option("checkpointLocation", f"{folder}/offsets")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(ANSWERS).parquet(f"{folder}/answers")
