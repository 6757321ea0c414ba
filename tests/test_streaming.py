"""Tables merged on read, the registry of fingerprints, the cache with time to live, and batches of jobs, over restarts."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexforge.operators import jobs
from lexforge.plans.tables import delete
from lexforge.streaming import registry, ttl_cache
from lexforge.streaming.merge_table import MergeTable

ROWS = "id long, h string, stamp int, a string, b string"


def plain_merge(batches, keep):
    """The reference: one batch after the other, the last of a key's rows counts."""
    table = {}
    for batch in batches:
        last = {}
        for row in batch:
            if row[0] not in last or row[2] >= last[row[0]][2]:
                last[row[0]] = row
        for key, row in last.items():
            old = table.get(key)
            if old and old[1] == row[1] and old[2] >= row[2]:
                continue
            table[key] = row[:4] + ((old[4],) if old and keep else row[4:])
    return set(table.values())


@pytest.mark.parametrize("keep", [(), ("b",)])
def test_merge_on_read(spark, tmp_path, keep):
    r = random.Random(1)
    batches = [[(i, r.choice("xyz"), n + r.randint(0, 2), f"{n}", f"first {n}") for i in r.sample(range(60), 25)] for n in range(6)]
    table = MergeTable(str(tmp_path / "t"), "id", "h", "stamp", keep)
    with pytest.raises(ValueError, match="nothing was merged"):
        table.read(spark)
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, ROWS)
        assert table.put(df, n)
        assert not table.put(df.where("id < 5"), n) and not table.put(df.limit(1), n - 1)
        if n in (2, 4):
            table.compact(spark)
        assert {tuple(x) for x in table.read(spark).collect()} == plain_merge(batches[: n + 1], keep)
    deltas = [p for p in (tmp_path / "t").iterdir() if p.name.startswith("delta")]
    assert len(deltas) == 6 and all(spark.read.parquet(str(p)).count() == 25 for p in deltas)
    table.vacuum(spark)
    assert {p.name.split("-")[0] + p.name.split("-")[1] for p in (tmp_path / "t").iterdir() if "-" in p.name} == {"base4", "delta5"}
    assert {tuple(x) for x in table.read(spark).collect()} == plain_merge(batches, keep)


def test_a_batch_that_broke_off_before_its_commit_is_written_again(spark, tmp_path):
    table = MergeTable(str(tmp_path / "t"), "id", "h", "stamp")
    first, second = ([(i, f"{n}", n, "a", "b") for i in range(n, n + 3)] for n in (0, 1))
    table.put(spark.createDataFrame(first, ROWS), 0)
    before = sorted(p.name for p in (tmp_path / "t/commits").glob("part*"))
    table.put(spark.createDataFrame(second, ROWS), 1)
    for p in (tmp_path / "t/commits").glob("*part*"):
        if p.name.lstrip(".").removesuffix(".crc") not in before:
            p.unlink()
    assert {tuple(x) for x in table.read(spark).collect()} == plain_merge([first], False)
    assert table.put(spark.createDataFrame(second, ROWS), 1)
    assert {tuple(x) for x in table.read(spark).collect()} == plain_merge([first, second], False)


def test_registry_over_batches_restarts_and_repeats(spark, tmp_path):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(15)]
    rows = []
    for i in range(200):
        fp = r.choice(base) ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 3))}) if r.random() < 0.9 else 0
        rows.append((i, fp - (1 << 64) if fp >= 1 << 63 else fp, r.random() < 0.7))
    wanted = {b for b, f, _ in rows if f and any(g and reg and a < b and ((f ^ g) & (1 << 64) - 1).bit_count() <= 2 for a, g, reg in rows)}
    source, folder = str(tmp_path / "in"), str(tmp_path / "gate")
    for n in range(4):
        spark.createDataFrame(rows[50 * n : 50 * n + 50], registry.ROWS).write.mode("append").parquet(source)
        registry.run(spark, source, folder)
    assert {x["id"] for x in registry.losers(spark, folder).collect()} == wanted
    assert len(list((tmp_path / "gate/registry").glob("batch=*"))) == 4
    # a batch that is run again after all others finds what it found
    registry.admit(spark.createDataFrame(rows[50:100], registry.ROWS), 1, folder, 2)
    assert {x["id"] for x in registry.losers(spark, folder).collect()} == wanted
    # equal prints register once
    assert spark.read.parquet(f"{folder}/registry").groupBy("path", "fp").count().where("count > 1").count() == 0
    registry.forget(spark, folder)
    assert not (tmp_path / "gate").exists()


def test_cache_answers_by_event_time_and_forgets(spark, tmp_path):
    def at(hours):
        return pd.Timestamp("2024-01-01") + pd.Timedelta(hours=hours)

    loads = [
        [("a", at(0), 1, "one"), ("a", at(1), 0, None), ("b", at(2), 2, "two"), ("a", at(3), 3, "three"), ("a", at(3), 9, None), ("c", at(1), 0, None)],
        [("a", at(20), 0, None), ("b", at(11.999), 0, None), ("b", at(12), 0, None), ("a", at(14.5), 0, None), ("a", at(2.5), 4, "older"), ("a", at(13), 0, None)],
        [("z", at(100), 7, "far")],
        [("b", at(101), 0, None), ("z", at(101), 0, None), ("y", at(200), 8, "further")],
    ]
    for rows in loads:
        spark.createDataFrame(pd.DataFrame(rows, columns=["key", "at", "number", "value"]), ttl_cache.REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = ttl_cache.run(spark, str(tmp_path / "in"), str(tmp_path / "cache"), hours=10)
    got = {(x["key"], x["at"], x["outcome"], x["value"]) for x in found.collect()}
    assert got == {
        ("a", at(1), "hit", "one"), ("a", at(3), "hit", "three"), ("c", at(1), "miss", None),
        ("a", at(20), "miss", None), ("a", at(14.5), "miss", None), ("a", at(13), "miss", None), ("b", at(11.999), "hit", "two"), ("b", at(12), "miss", None),
        ("a", at(13), "expired", "three"), ("b", at(12), "expired", "two"), ("b", at(101), "miss", None), ("z", at(101), "hit", "far"), ("z", at(110), "expired", "far"),
    }


def sleeps(seconds):
    def run(batches):
        for batch in batches:
            time.sleep(seconds)
            yield batch

    return run


def test_a_job_that_hangs_is_cancelled_twice_and_the_rest_goes_on(spark, tmp_path):
    ran = []

    def work(session, job):
        ran.append(job)
        numbers = session.range({"fast1": 1, "fast2": 2, "hang1": 3, "fast3": 4, "bad": 5}[job], numPartitions=1)
        if job == "hang1":
            numbers = numbers.mapInPandas(sleeps(120), "id long")
        if job == "bad":
            raise ValueError("no such thing")
        return numbers.agg((F.count("id") * 2).alias("doubled"))

    names = ["fast1", "fast2", "hang1", "fast3", "bad"]
    session = spark
    session.range(1).mapInPandas(sleeps(0), "id long").collect()  # workers are up
    batch = jobs.Batch(session, str(tmp_path))
    began = time.time()
    states = batch.run(names, work, deadline=6, at_once=2)
    assert time.time() - began < 60
    assert states == {"fast1": "done", "fast2": "done", "fast3": "done", "hang1": "given up", "bad": "failed"}
    assert sorted(ran) == sorted([*names, "hang1"])
    assert {(r["job"], r["doubled"]) for r in batch.results().collect()} == {("fast1", 2), ("fast2", 4), ("fast3", 8)}
    log = {(r["job"], r["attempt"], r["outcome"]) for r in batch.log().collect()}
    assert {x for x in log if x[0] == "hang1"} == {("hang1", 1, "hung"), ("hang1", 2, "hung")}
    assert "no such thing" in batch.log().where("job = 'bad'").first()["error"]
    ran.clear()
    assert jobs.Batch(session, str(tmp_path)).run([*names, "fast4"][:5], work, deadline=6) == states and ran == []


def test_a_second_start_runs_what_is_pending(spark, tmp_path):
    """Two jobs in the first start; one result is written but its line is lost, so it is made again."""
    calls = []

    def work(session, job):
        calls.append(job)
        return session.range(len(calls)).agg(F.count("id").alias("n"))

    batch = jobs.Batch(spark, str(tmp_path))
    assert batch.run(["a", "b", "c/d e"], work, deadline=60, most=2) == {"a": "done", "b": "done", "c/d e": "pending"}
    work(spark, "left").write.parquet(f"{tmp_path}/results/c%2Fd%20e/1")
    assert jobs.Batch(spark, str(tmp_path)).run(["a", "b", "c/d e"], work, deadline=60) == {"a": "done", "b": "done", "c/d e": "done"}
    assert calls == ["a", "b", "left", "c/d e"]
    assert {(r["job"], r["n"]) for r in batch.results().collect()} == {("a", 1), ("b", 2), ("c/d e", 4)}
    delete(spark, str(tmp_path))
    assert batch.results() is None


def test_queue_of_rows(spark, tmp_path):
    from lexforge.streaming.queue import Queue

    def at(minutes):
        return F.lit(f"2024-01-01 00:{minutes:02d}:00").cast("timestamp")

    items, work = spark.range(10), Queue(str(tmp_path / "q"))
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(work.claim(items, "a", 4, at(0), 300)) == [0, 1, 2, 3]
    assert ids(work.claim(items, "b", 3, at(1), 300)) == [4, 5, 6]
    assert work.end(items.where("id IN (0, 1, 5)"), "a") == 2  # the fifth is another's
    assert ids(work.pending(items, at(2))) == [7, 8, 9]
    assert ids(work.pending(items, at(5))) == [2, 3, 7, 8, 9]
    assert ids(work.claim(items, "b", 2, at(5), 300)) == [2, 3]
    assert work.end(items.where("id IN (2, 3)"), "a") == 0
    assert work.end(items.where("id = 2"), "b", "failed") == 1
    assert {(r["id"], r["state"], r["worker"]) for r in work.states(spark).collect()} == {
        (0, "completed", "a"), (1, "completed", "a"), (2, "failed", "b"), (3, "claimed", "b"), (4, "claimed", "b"), (5, "claimed", "b"), (6, "claimed", "b"),
    }
