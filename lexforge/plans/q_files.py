"""Queries of the file connectors: tables go out in a format, in the shared folder, and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexforge.operators import aggregates as A
from lexforge.operators import retrieval as N
from lexforge.plans.q_retrieval import BM25, asked, docs
from lexforge.plans.tables import checkpoint_dir, load
from lexforge.registry import query
from lexforge.sources import files as S
from lexforge.sources.views import view, with_views

c = F.col


def fresh(spark) -> str:
    return f"{checkpoint_dir(spark)}/lexforge/{uuid.uuid4().hex}"


@query("a29_csv_telemetry", with_views("telemetry", then="SELECT site, count(*) AS n, count_if(is_anomaly) AS anomalies, round(sum(production_power_w), 4) AS total, count(anomaly_type) AS typed FROM telemetry GROUP BY 1"))
def a29(spark, sf):
    path = fresh(spark)
    order = [x.split()[0] for x in S.TELEMETRY.split(", ")]
    view(spark, sf, "telemetry").select(order).write.option("header", "true").csv(path)
    return S.telemetry_csv(spark, path).groupBy("site").agg(F.count(F.lit(1)).alias("n"), A.n_where(c("is_anomaly")).alias("anomalies"), F.round(F.sum("production_power_w"), 4).alias("total"), F.count("anomaly_type").alias("typed"))


@query("a28_json_catalog", "SELECT p_type AS name, CAST(count(DISTINCT p_brand) AS INT) AS keywords FROM part GROUP BY 1")
def a28(spark, sf):
    path = fresh(spark)
    load(spark, sf, "part").groupBy(c("p_type").alias("name")).agg(F.array_sort(F.collect_set("p_brand")).alias("keywords")).write.json(path)
    return spark.read.schema("name string, keywords array<string>").json(path).select("name", F.size("keywords").alias("keywords"))


@query("a16_feed", with_views("candidates", then="SELECT trim(title) AS title, url AS link, length(CASE WHEN length(t) > 500 THEN concat(substring(t, 1, 500), '...') ELSE t END) AS chars FROM (SELECT title, url, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM candidates)"))
def a16(spark, sf):
    """Pages as the items of a feed."""
    from lexforge.functions.web import strip_tags

    path = fresh(spark)
    view(spark, sf, "candidates").select("title", c("url").alias("link"), strip_tags(c("html")).alias("description")).write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    return S.feed_items(spark, path).select("title", "link", F.length("snippet").cast("long").alias("chars"))


@query("a17_feed_search", "SELECT item_id FROM benchmark WHERE contains(lower(text), 'the') OR contains(lower(text), 'der')")
def a17_feed(spark, sf):
    items = load(spark, sf, "benchmark").select("item_id", F.lit("").alias("title"), c("text").alias("snippet"))
    return S.matching(items, "The DER").select("item_id")


@query("b10_vectors", "SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, 1.0::DOUBLE AS norm FROM (SELECT vec_id FROM embeddings UNION ALL SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def b10(spark, sf):
    """Appended twice, then compacted: repeats stay, lengths are one."""
    path, target = fresh(spark), fresh(spark)
    vectors = load(spark, sf, "embeddings").select("vec_id", c("embedding").alias("vector"))
    S.append_vectors(vectors, path)
    S.append_vectors(vectors.where("vec_id % 2 = 0"), path)
    S.compact(spark, path, target, 2)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return spark.read.parquet(target).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids"), F.round(F.avg(norm), 5).alias("norm"))


@query("b11_rebuild", "SELECT count(*) AS n FROM embeddings WHERE vec_id % 2 = 0")
def b11(spark, sf):
    path = fresh(spark)
    vectors = load(spark, sf, "embeddings").select("vec_id", c("embedding").alias("vector"))
    S.append_vectors(vectors, path)
    S.append_vectors(vectors.where("vec_id % 2 = 0"), path, rebuild=True)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


@query("b13_snapshot", with_views("content", then="SELECT 'by_type' AS name, CAST(count(DISTINCT content_type) AS INT) AS parts FROM content UNION ALL SELECT 'by_language', CAST(count(DISTINCT language) AS INT) FROM content"))
def b13(spark, sf):
    """Dashboard parts as JSON, written and read."""
    path = fresh(spark)
    content = view(spark, sf, "content")
    parts = {"by_type": A.by_format(content, "content_type"), "by_language": content.groupBy("language").agg(F.count(F.lit(1)).alias("n"))}
    S.snapshot(parts).write.json(path)
    return spark.read.schema("name string, json string").json(path).select("name", F.json_array_length("json").alias("parts"))


@query("b15_logs", with_views("system_logs", then="SELECT level, count(*) AS n FROM system_logs GROUP BY 1"))
def b15(spark, sf):
    path = fresh(spark)
    rows = S.log_rows(view(spark, sf, "system_logs"), "20240101_abc123", F.struct("source", "action"))
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("x03_discovery_totals", with_views("attempts", then="SELECT count(*) AS found, CAST(sum(approved) AS BIGINT) AS approved, CAST(sum(rejected) AS BIGINT) AS rejected FROM attempts"))
def x03(spark, sf):
    return view(spark, sf, "attempts").agg(F.count(F.lit(1)).alias("found"), F.sum("approved").cast("long").alias("approved"), F.sum("rejected").cast("long").alias("rejected"))


@query("x07_cluster_kpi", "SELECT max(n) AS largest, count(*) AS clusters FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def x07(spark, sf):
    return load(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"), F.count(F.lit(1)).alias("clusters"))


@query("e38_crosstab", with_views("content", then="SELECT language, count_if(content_type = 'text') AS text, count_if(content_type = 'pdf') AS pdf, count_if(content_type = 'html') AS html, count_if(content_type = 'audio') AS audio FROM content GROUP BY 1"))
def e38(spark, sf):
    """A pivot over a fixed list of formats, so that they need no pass of their own."""
    pivot = view(spark, sf, "content").groupBy("language").pivot("content_type", ["text", "pdf", "html", "audio"]).agg(F.count(F.lit(1)))
    return pivot.select("language", *[F.coalesce(c(x), F.lit(0)).alias(x) for x in ("text", "pdf", "html", "audio")])


@query("x15_without_summary", with_views("content", then="SELECT id FROM content WHERE screening_status = 'approved' AND transcript <> '' AND (pub_date IS NULL OR pub_date = '')"))
def x15(spark, sf):
    """Approved rows whose text column (here the date) is null or empty."""
    rows = view(spark, sf, "content").where((c("screening_status") == "approved") & (c("transcript") != ""))
    return rows.where(F.coalesce("pub_date", F.lit("")) == "").select("id")


@query("x19_inventory_text", with_views("content", then="SELECT string_agg(CAST(n AS STRING) || ' ' || content_type, ', ' ORDER BY n DESC, content_type) AS line FROM (SELECT content_type, count(*) AS n FROM content GROUP BY 1)"))
def x19(spark, sf):
    counts = view(spark, sf, "content").groupBy("content_type").agg(F.count(F.lit(1)).alias("n"))
    parts = counts.agg(F.array_sort(F.collect_list(F.struct((-c("n")).alias("m"), "content_type"))).alias("p"))
    return parts.select(F.array_join(F.transform("p", lambda x: F.concat_ws(" ", (-x["m"]).cast("string"), x["content_type"])), ", ").alias("line"))


@query(
    "x20_context",
    f"WITH {BM25} SELECT qid, md5(string_agg('[' || source || ']' || chr(10) || substring(text, 1, 2000), chr(10) || '---' || chr(10) ORDER BY rank)) AS digest FROM bm JOIN documents d ON d.doc_id = bm.doc_id WHERE rank < 5 GROUP BY 1",
)
def x20(spark, sf):
    """Sources and excerpts of each passage's best five documents, in their order, as one context."""
    hits = N.bm25(docs(spark, sf), asked(spark, sf), 5)
    text = F.concat(F.lit("["), "source", F.lit("]\n"), F.substring("text", 1, 2000)).alias("t")
    rows = docs(spark, sf).join(N.few(hits), "doc_id").select("qid", F.struct("rank", text).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), "\n---\n")
    return rows.groupBy("qid").agg(F.md5(joined.cast("binary")).alias("digest"))


@query("x21_sources_if_used", with_views("content", then="SELECT id, CASE WHEN id % 2 = 0 THEN source_name ELSE '' END AS sources FROM content"))
def x21(spark, sf):
    used = c("id") % 2 == 0
    return view(spark, sf, "content").select("id", F.array_join(F.when(used, F.array("source_name")).otherwise(F.array().cast("array<string>")), ",").alias("sources"))
