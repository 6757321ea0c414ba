"""Batches of Spark jobs that have a deadline, are cancelled when it passes, and are taken up again where they ended."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators.merging import job_states
from lexforge.plans.tables import exists

LOG = "job string, attempt int, outcome string, error string, seconds double"
#: Seconds that a cancelled job gets to end before its thread is left behind.
GRACE = 30.0

Work = Callable[[SparkSession, str], DataFrame]


class Batch:
    """Jobs by name in ``folder``: ``log`` has a line for the outcome of each attempt (done, failed or hung), and an attempt's result
    is a table of its own. What has no line was never finished: an attempt that the driver's end broke off is made again, and the
    files that it left are not read."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self._lock = spark, folder, threading.Lock()

    def log(self) -> DataFrame:
        path = f"{self.folder}/log"
        return self.spark.read.schema(LOG).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], LOG)

    def states(self, jobs: Sequence[str], attempts: int = 2) -> dict[str, str]:
        """done, failed, given up or pending, of each job of the list."""
        named = self.spark.createDataFrame([(j,) for j in jobs], "job string")
        return {r["job"]: r["state"] for r in job_states(named, self.log(), ["job"], attempts).collect()}

    def _path(self, job: str, attempt: int) -> str:
        return f"{self.folder}/results/{quote(job, safe='')}/{attempt}"

    def _note(self, job: str, attempt: int, outcome: str, error: str | None, seconds: float) -> None:
        with self._lock:  # writers of one folder would clear each other's unfinished files
            self.spark.createDataFrame([(job, attempt, outcome, error, seconds)], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def _attempt(self, job: str, attempt: int, work: Work, deadline: float) -> str:
        context, group, ended = self.spark.sparkContext, f"{self.folder}#{job}#{attempt}", {}

        def body() -> None:
            context.setJobGroup(group, job, interruptOnCancel=True)
            try:
                work(self.spark, job).write.mode("overwrite").parquet(self._path(job, attempt))
                ended["outcome"] = "done"
            except Exception as error:
                ended.update(outcome="failed", error=str(error).splitlines()[0][:500] if str(error) else type(error).__name__)

        thread, began = InheritableThread(target=body, daemon=True), time.monotonic()
        thread.start()
        thread.join(deadline)
        if thread.is_alive():
            until = time.monotonic() + GRACE
            while thread.is_alive() and time.monotonic() < until:
                context.cancelJobGroup(group)  # again and again: a query may be between two of its jobs
                thread.join(0.5)
            ended = {"outcome": "hung", "error": f"cancelled after {deadline:g} s"}
        self._note(job, attempt, ended["outcome"], ended.get("error"), time.monotonic() - began)
        return ended["outcome"]

    def run(self, jobs: Sequence[str], work: Work, deadline: float, attempts: int = 2, at_once: int = 1, most: int | None = None) -> dict[str, str]:
        """Run the pending jobs of the list, ``at_once`` side by side and ``most`` at most in this start, and return all states. A
        job that hangs is tried again until it has hung ``attempts`` times; one that fails is not. Others go on meanwhile."""
        tried = {r["job"]: r["n"] for r in self.log().groupBy("job").agg(F.count(F.lit(1)).alias("n")).collect()}
        pending = [j for j, state in self.states(jobs, attempts).items() if state == "pending"]

        def until_settled(job: str) -> None:
            for attempt in range(tried.get(job, 0) + 1, attempts + 1):
                if self._attempt(job, attempt, work, deadline) != "hung":
                    break

        with ThreadPoolExecutor(at_once) as pool:
            list(pool.map(until_settled, sorted(pending)[:most]))
        return self.states(jobs, attempts)

    def results(self) -> DataFrame | None:
        """The tables of all jobs that are done, with their job, as one; null if there is none."""
        done = [(r["job"], r["attempt"]) for r in self.log().where("outcome = 'done'").select("job", "attempt").distinct().collect()]
        found = None
        for job, attempt in sorted(done):
            one = self.spark.read.parquet(self._path(job, attempt)).withColumn("job", F.lit(job))
            found = one if found is None else found.unionByName(one, allowMissingColumns=True)
        return found
