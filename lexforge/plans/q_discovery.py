"""Queries of discovery planning; the catalogs are small columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import discovery as R
from lexforge.plans.tables import load
from lexforge.registry import query

c = F.col
TEMPLATES = ("{vendor} {topic} manual", "{topic} best practices", "{vendor} datasheet")
CATALOGS = "pt AS (SELECT unnest(['{vendor} {topic} manual', '{topic} best practices', '{vendor} datasheet']) AS template), ve AS (SELECT DISTINCT p_brand AS vendor FROM part), tp AS (SELECT DISTINCT p_type AS topic FROM part), dt AS (SELECT DISTINCT c_mktsegment AS doc_type FROM customer), sd AS (SELECT r_name AS standard FROM region)"


def plan(spark, sf):
    part = load(spark, sf, "part")
    patterns = spark.createDataFrame([(t,) for t in TEMPLATES], "template string")
    return R.queries(patterns, part.select(c("p_brand").alias("vendor")).distinct(), part.select(c("p_type").alias("topic")).distinct(), load(spark, sf, "customer").select(c("c_mktsegment").alias("doc_type")).distinct(), load(spark, sf, "region").select(c("r_name").alias("standard")))


@query("r02_plan", f"WITH {CATALOGS} SELECT kind, query, count(*) AS n FROM (SELECT 'pattern' AS kind, replace(replace(template, '{{vendor}}', vendor), '{{topic}}', topic) AS query FROM pt, ve, tp UNION ALL SELECT 'type', concat_ws(' ', topic, doc_type) FROM pt, tp, dt UNION ALL SELECT 'standard', standard FROM sd) GROUP BY ALL")
def r02(spark, sf):
    return plan(spark, sf).groupBy("kind", "query").agg(F.count(F.lit(1)).alias("n"))


@query("r04_caps", f"WITH {CATALOGS} SELECT kind, query FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY query) AS r FROM (SELECT DISTINCT 'pattern' AS kind, replace(replace(template, '{{vendor}}', vendor), '{{topic}}', topic) AS query FROM pt, ve, tp UNION SELECT 'type', concat_ws(' ', topic, doc_type) FROM pt, tp, dt UNION SELECT 'standard', standard FROM sd)) WHERE r <= 10")
def r04(spark, sf):
    return R.capped(plan(spark, sf).distinct(), "kind", "query", 10)


@query("r01_topics", "SELECT DISTINCT p_type AS name FROM part WHERE contains(lower(p_type), 'small') OR contains(lower(p_brand), 'small')")
def r01(spark, sf):
    catalog = load(spark, sf, "part").groupBy(c("p_type").alias("name")).agg(F.collect_set("p_brand").alias("keywords"))
    return R.topics(catalog, F.lit("small")).select("name")


@query("r06_classified", "SELECT p.page_id, CASE WHEN p.page_id % 4 = 0 THEN 'cache' WHEN b.quality IS NOT NULL THEN 'judge' ELSE 'default' END AS origin, CASE WHEN p.page_id % 4 = 0 THEN p.page_id % 8 = 0 ELSE coalesce(b.quality = 1, false) END AS approved FROM pages p LEFT JOIN labels b ON p.page_id = b.doc_id")
def r06(spark, sf):
    """Cached answers first, then the judge's (here the labels), else rejected."""
    pages = load(spark, sf, "pages").select("page_id")
    cache = pages.where("page_id % 4 = 0").select("page_id", (c("page_id") % 8 == 0).alias("relevant"), F.lit(0.9).alias("confidence"))
    judged = load(spark, sf, "labels").select(c("doc_id").alias("page_id"), (c("quality") == 1).alias("relevant"), F.lit(0.8).alias("confidence"))
    return R.classified(pages, cache, judged, "page_id").select("page_id", "origin", "approved")


@query("r08_live_cache", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL '24 hours' AND ts <= TIMESTAMP '2024-01-15 00:00:00'")
def r08(spark, sf):
    now = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    cache = load(spark, sf, "events").select("event_id", c("ts").cast("timestamp_ntz").alias("created_at"))
    return R.live(cache, now, 24).where(c("created_at") <= now).select("event_id")
