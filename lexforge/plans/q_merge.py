"""Queries of merges, cursors and incremental jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lexforge.operators import dedup as D
from lexforge.operators import jobs
from lexforge.operators import merging as B
from lexforge.plans.fragments import PRINTS
from lexforge.plans.tables import folder, load, materialize
from lexforge.registry import query
from lexforge.sources.views import view, with_views
from lexforge.streaming import incremental, registry, ttl_cache
from lexforge.streaming.merge_table import MergeTable
from lexforge.streaming.queue import Queue

c = F.col
TABLES = """WITH stored AS (SELECT o_orderkey AS id, md5(CAST(o_custkey AS STRING)) AS h, 1 AS stamp, o_orderstatus AS status, 'completed' AS vectors FROM orders WHERE o_orderkey % 3 <> 0),
incoming AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE md5(CAST(o_custkey AS STRING)) END AS h, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS stamp, 'N' AS status, 'new' AS vectors FROM orders WHERE o_orderkey % 2 = 0),
m AS (SELECT coalesce(i.id, s.id) AS id, s.id IS NULL AS ins, i.id IS NULL AS kept, i.h IS NOT DISTINCT FROM s.h AS same, s.h AS oh, i.h AS nh, s.stamp AS os, i.stamp AS ns, s.status AS ost, i.status AS nst, s.vectors AS ov, i.vectors AS nv FROM incoming i FULL OUTER JOIN stored s ON i.id = s.id),
a AS (SELECT *, CASE WHEN ins THEN 'inserted' WHEN kept THEN 'kept' WHEN same AND os >= ns THEN 'skipped' ELSE 'updated' END AS action FROM m)"""


def merged(spark, sf):
    orders = load(spark, sf, "orders")
    h = F.md5(c("o_custkey").cast("string").cast("binary"))
    stored = orders.where("o_orderkey % 3 <> 0").select(c("o_orderkey").alias("id"), h.alias("h"), F.lit(1).alias("stamp"), c("o_orderstatus").alias("status"), F.lit("completed").alias("vectors"))
    incoming = orders.where("o_orderkey % 2 = 0").select(c("o_orderkey").alias("id"), F.when(c("o_orderkey") % 5 == 0, "changed").otherwise(h).alias("h"), F.when(c("o_orderkey") % 7 == 0, 2).otherwise(1).alias("stamp"), F.lit("N").alias("status"), F.lit("new").alias("vectors"))
    return B.upsert(stored, incoming, "id", "h", "stamp", on_change={"vectors": F.lit("pending")})


@query("b02_upsert", TABLES + " SELECT id, action, CASE WHEN action IN ('kept', 'skipped') THEN oh ELSE nh END AS h, CASE WHEN action IN ('kept', 'skipped') THEN ost ELSE nst END AS status, CASE WHEN ins THEN nv WHEN kept OR same THEN ov ELSE 'pending' END AS vectors FROM a")
def b02(spark, sf):
    return merged(spark, sf).select("id", "action", "h", "status", "vectors")


@query("b02_counts", TABLES + " SELECT action, count(*) AS n FROM a GROUP BY 1")
def b02_counts(spark, sf):
    return merged(spark, sf).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("b01_new_ids", "SELECT c_custkey, 1000 + c_custkey - min(c_custkey) OVER () + 1 AS id FROM customer WHERE c_custkey < 0 UNION ALL SELECT count(*), max(c_custkey) - max(c_custkey) + count(*) + 1000 FROM customer")
def b01(spark, sf):
    """Ids of new rows are gapless after the largest stored one: their number and their last."""
    new = B.numbered(load(spark, sf, "customer").select("c_custkey"), 1000, "c_custkey")
    return new.agg(F.countDistinct("id").alias("c_custkey"), F.max("id").alias("id"))


@query("b05_aliases", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, CASE WHEN event_id % 2 = 0 THEN props END, '') AS url FROM events")
def b05(spark, sf):
    """A value under either of two names, else empty."""
    e = load(spark, sf, "events")
    return e.select("event_id", F.coalesce(F.when(c("event_id") % 3 == 0, c("event_type")), F.when(c("event_id") % 2 == 0, c("props")), F.lit("")).alias("url"))


@query("b08_cache_put", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def b08(spark, sf):
    rows = load(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    return B.last_writer(rows, ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id")


@query("b09_delete_rejected", with_views("signals", "content", then="SELECT id FROM signals WHERE source_content_id NOT IN (SELECT id FROM content WHERE screening_status IN ('rejected', 'dq_rejected'))"))
def b09(spark, sf):
    """Signals without those of rejected documents."""
    gone = view(spark, sf, "content").where(c("screening_status").isin("rejected", "dq_rejected")).select(c("id").alias("source_content_id"))
    return B.without(view(spark, sf, "signals").select("id", "source_content_id"), gone, "source_content_id").select("id")


@query("b14_migrate", "SELECT c_custkey AS id, c_name AS title, CAST(NULL AS STRING) AS verified_by, false AS do_not_vectorize FROM customer")
def b14(spark, sf):
    from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

    schema = StructType([StructField("id", LongType()), StructField("title", StringType()), StructField("verified_by", StringType()), StructField("do_not_vectorize", BooleanType())])
    return B.migrate(load(spark, sf, "customer"), schema, {"c_custkey": "id", "c_name": "title"}, {"do_not_vectorize": False})


@query("d07_unvectorized", "SELECT doc_id FROM documents WHERE CAST(doc_id AS STRING) NOT IN (SELECT CAST(vec_id AS STRING) FROM embeddings WHERE vec_id % 2 = 0)")
def d07(spark, sf):
    """Documents whose id, as text, has no vector yet."""
    have = load(spark, sf, "embeddings").where("vec_id % 2 = 0").select(c("vec_id").cast("string").alias("k"))
    return load(spark, sf, "documents").select("doc_id", c("doc_id").cast("string").alias("k")).join(have, "k", "left_anti").select("doc_id")


@query("g03_pair_cursor", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts, event_id LIMIT 200")
def g03_pair(spark, sf):
    rows = load(spark, sf, "events").select("event_id", c("ts").cast("timestamp_ntz").alias("ts"))
    return B.page_after(rows, "ts", F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"), 200, "event_id", F.lit(1 << 62)).select("event_id")


@query("o01_streamed_sync", "SELECT count(*) AS n, count(DISTINCT doc_id) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents")
def o01(spark, sf):
    """The documents, pulled file by file into a merged table by a stream that has run to its end."""
    base = folder(spark)
    source = load(spark, sf, "documents").select("doc_id", F.md5(c("text").cast("binary")).alias("h"), F.lit(1).alias("stamp"), "n_chars")
    source.repartition(3, "doc_id").write.parquet(f"{base}/in")
    table = MergeTable(f"{base}/table", "doc_id", "h", "stamp")
    incremental.sync(spark, f"{base}/in", source.schema, table, f"{base}/offsets", files=1, compact=2)
    return table.read(spark).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"), F.sum("n_chars").alias("chars"))


ORDERS = """WITH RECURSIVE b AS (SELECT o_orderkey AS id, n, md5(concat(CAST(o_custkey AS STRING), CASE WHEN o_orderkey % (n + 2) = 0 THEN CAST(n AS STRING) ELSE '' END)) AS h, CASE WHEN o_orderkey % 5 = n THEN 0 ELSE n END AS stamp, concat(o_orderstatus, CAST(n AS STRING)) AS status
  FROM orders, (SELECT unnest([0, 1, 2, 3]) AS n) WHERE (o_orderkey + n) % 3 <> 0),
s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM b),
f AS (SELECT id, k, h, stamp, status, status AS first FROM s WHERE k = 1 UNION ALL
  SELECT s.id, s.k, CASE WHEN f.h = s.h AND f.stamp >= s.stamp THEN f.h ELSE s.h END, CASE WHEN f.h = s.h AND f.stamp >= s.stamp THEN f.stamp ELSE s.stamp END, CASE WHEN f.h = s.h AND f.stamp >= s.stamp THEN f.status ELSE s.status END, f.first FROM f JOIN s ON s.id = f.id AND s.k = f.k + 1)"""


@query("o01_merged_batches", ORDERS + " SELECT id, h, stamp, status, first FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS last FROM f) WHERE last = 1")
def o01_batches(spark, sf):
    """Four batches of changes to the orders, each sent twice, with a new base after the third; a column that keeps its first value."""
    orders = load(spark, sf, "orders")
    table = MergeTable(f"{folder(spark)}/table", "id", "h", "stamp", keep=("first",))
    for n in range(4):
        changed = F.when(c("o_orderkey") % (n + 2) == 0, str(n)).otherwise("")
        h = F.md5(F.concat(c("o_custkey").cast("string"), changed).cast("binary"))
        stamp = F.when(c("o_orderkey") % 5 == n, 0).otherwise(n)
        status = F.concat("o_orderstatus", F.lit(str(n)))
        rows = orders.where((c("o_orderkey") + n) % 3 != 0).select(c("o_orderkey").alias("id"), h.alias("h"), stamp.alias("stamp"), status.alias("status"), status.alias("first"))
        for _ in range(2):
            table.put(rows, n)
        if n == 2:
            table.compact(spark)
    return table.read(spark)


@query(
    "o02_work_queue",
    """WITH d AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS r FROM documents)
    SELECT id, CASE WHEN r <= 100 AND id % 2 = 0 THEN 'completed' WHEN id % 7 = 0 THEN 'failed' WHEN id % 7 = 1 THEN 'claimed' ELSE 'completed' END AS state, CASE WHEN r <= 100 AND id % 2 = 0 THEN 'a' ELSE 'b' END AS worker FROM d""",
)
def o02(spark, sf):
    """One worker claims a hundred documents, completes half of them and is lost; an hour later another gets all that are left,
    completes most, fails at some and still holds the rest."""
    items = load(spark, sf, "documents").select(c("doc_id").alias("id"))
    work, early, late = Queue(folder(spark)), F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 01:00:00").cast("timestamp")
    taken = work.claim(items, "a", 100, early, seconds=600)
    work.end(taken.where("id % 2 = 0"), "a")
    rest = materialize(work.claim(items, "b", 1 << 30, late, seconds=600))
    work.end(rest.where("id % 7 = 0"), "b", "failed")
    work.end(rest.where("id % 7 > 1"), "b")
    return work.states(spark).select("id", "state", "worker")


@query(
    "o04_streamed_gate",
    f"WITH {PRINTS} SELECT id FROM f b WHERE b.fp <> 0 AND EXISTS (SELECT 1 FROM f a JOIN documents d ON a.id = d.doc_id WHERE a.id < b.id AND a.fp <> 0 AND length(d.text) >= 200 AND bit_count(xor(a.fp, b.fp)) <= 2)",
)
def o04(spark, sf):
    """The near duplicates among documents that arrive in three loads, in the order of their ids; the gate is started anew for each
    and knows what came before."""
    base = folder(spark)
    docs = load(spark, sf, "documents")
    lengths = docs.select(c("doc_id").alias("id"), (F.length("text") >= 200).alias("registers"))
    rows = materialize(D.md5_simhash(docs, "doc_id", "text").join(lengths, "id").select("id", "fp", "registers"))
    bounds = rows.agg(F.percentile_approx("id", [0.34, 0.67])).first()[0] or []
    load_of = reduce(lambda n, bound: n + (c("id") > bound).cast("int"), bounds, F.lit(0))
    for n in range(len(bounds) + 1):
        rows.where(load_of == n).write.mode("append").parquet(f"{base}/in")
        registry.run(spark, f"{base}/in", f"{base}/gate")
    return registry.losers(spark, f"{base}/gate")


ASKED = ("2024-01-05 06:00:00", "2024-01-15 00:00:00", "2024-01-25 18:30:00")


@query(
    "o05_ttl_cache",
    f"""WITH p AS (SELECT concat(CAST(user_id % 500 AS STRING), ':', event_type) AS key, ts, event_id FROM events), k AS (SELECT DISTINCT key FROM p), g AS (SELECT key, CAST(t AS TIMESTAMP) AS asked FROM k, (SELECT unnest({list(ASKED)}) AS t)),
    l AS (SELECT g.key, g.asked, p.event_id, p.ts, row_number() OVER (PARTITION BY g.key, g.asked ORDER BY p.ts DESC NULLS LAST, p.event_id DESC) AS r FROM g LEFT JOIN p ON p.key = g.key AND p.ts <= g.asked)
    SELECT key, strftime(asked, '%Y-%m-%d %H:%M:%S') AS asked, CASE WHEN ts > asked - INTERVAL '24 hours' THEN 'hit' ELSE 'miss' END AS outcome, CASE WHEN ts > asked - INTERVAL '24 hours' THEN event_id ELSE -1 END AS event_id FROM l WHERE r = 1""",
)
def o05(spark, sf):
    """Events put themselves under a user and a type; every key is asked for at three times. They arrive in two loads, the second
    after a restart."""
    base = folder(spark)
    key = F.concat((c("user_id") % 500).cast("string"), F.lit(":"), c("event_type"))
    puts = load(spark, sf, "events").select(key.alias("key"), c("ts").cast("timestamp").alias("at"), c("event_id").alias("number"), c("event_id").cast("string").alias("value"))
    times = F.explode(F.array(*[F.lit(t).cast("timestamp") for t in ASKED]))
    gets = puts.select("key").distinct().select("key", times.alias("at"), F.lit(0).cast("long").alias("number"), F.lit(None).cast("string").alias("value"))
    requests = materialize(puts.unionByName(gets))
    for later in (False, True):
        requests.where((c("at") > F.lit(ASKED[1]).cast("timestamp")) == later).write.mode("append").parquet(f"{base}/in")
        found = ttl_cache.run(spark, f"{base}/in", f"{base}/cache", hours=24)
    return found.where("outcome <> 'expired'").select("key", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("asked"), "outcome", F.coalesce(c("value").cast("long"), F.lit(-1)).alias("event_id"))


@query("o06_batch", "SELECT event_type AS job, count(*) AS n, round(sum(value), 6) AS total, CASE WHEN dense_rank() OVER (ORDER BY event_type) <= 2 THEN 1 ELSE 2 END AS start FROM events GROUP BY event_type")
def o06_batch(spark, sf):
    """A job for each type of event; the first start ends after two jobs, the second runs those that are left."""
    events = load(spark, sf, "events").select("event_type", "value")
    types = [r["event_type"] for r in events.select("event_type").distinct().collect()]  # a catalog of few
    batch = jobs.Batch(spark, folder(spark))
    for start, most in ((1, 2), (2, None)):

        def work(session, job, start=start):
            own = events.where(c("event_type") == job)
            return own.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.lit(start).alias("start"))

        states = batch.run(types, work, deadline=600, at_once=2, most=most)
    if set(states.values()) - {"done"}:
        raise RuntimeError(f"jobs have failed: {states}")
    return batch.results().select("job", "n", "total", "start")


@query("o08_streamed_windows")
def o08_stream(spark, sf):
    """Hourly windows of the events by a stream with a watermark: those that have closed."""
    base = folder(spark)
    events = load(spark, sf, "events").select(c("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.repartition(2).write.parquet(f"{base}/in")
    return incremental.run_windows(spark, f"{base}/in", events.schema, f"{base}/out", f"{base}/offsets")


@query("o06_resume", "SELECT event_id, value * 2 AS doubled FROM events WHERE event_id % 4 <> 0")
def o06(spark, sf):
    """A batch that resumes: jobs that a checkpoint table has done are left out."""
    jobs = load(spark, sf, "events").select("event_id", "value")
    done = jobs.where("event_id % 4 = 0").select("event_id")
    return B.without(jobs, done, "event_id").select("event_id", (c("value") * 2).alias("doubled"))


@query(
    "o06_attempts",
    """WITH j AS (SELECT DISTINCT user_id % 50 AS job, CAST(ts AS DATE) AS day FROM events), l AS (SELECT user_id % 50 AS job, CAST(ts AS DATE) AS day, CASE WHEN event_id % 7 = 0 THEN 'done' WHEN event_id % 11 = 0 THEN 'failed' ELSE 'hung' END AS outcome FROM events WHERE event_id % 3 = 0),
    s AS (SELECT job, day, bool_or(outcome = 'done') AS d, bool_or(outcome = 'failed') AS f, count(CASE WHEN outcome = 'hung' THEN 1 END) AS h FROM l GROUP BY ALL)
    SELECT j.job, strftime(j.day, '%Y-%m-%d') AS day, CASE WHEN d THEN 'done' WHEN f THEN 'failed' WHEN h >= 2 THEN 'given up' ELSE 'pending' END AS state FROM j LEFT JOIN s ON j.job = s.job AND j.day = s.day""",
)
def o06_attempts(spark, sf):
    """States of jobs by what a log of attempts says; a job that has hung twice is not tried again."""
    events = load(spark, sf, "events").select((c("user_id") % 50).alias("job"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id")
    outcome = F.when(c("event_id") % 7 == 0, "done").when(c("event_id") % 11 == 0, "failed").otherwise("hung")
    log = events.where("event_id % 3 = 0").select("job", "day", outcome.alias("outcome"))
    return B.job_states(events, log, ["job", "day"])
