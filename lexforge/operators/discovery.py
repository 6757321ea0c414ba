"""Planning of searches and classification of their candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.operators.retrieval import few


def topics(catalog: DataFrame, wanted: Column) -> DataFrame:
    """Topics whose name or joined keywords hold the wanted word; without any, one made of the word itself."""
    found = catalog.where(F.lower("name").contains(F.lower(wanted)) | F.lower(F.array_join("keywords", " ")).contains(F.lower(wanted)))
    made = catalog.sparkSession.range(1).select(wanted.alias("name"), F.array(wanted).alias("keywords"))
    none = found.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return found.select("name", "keywords").unionByName(made.crossJoin(none).select("name", "keywords"))


def queries(patterns: DataFrame, vendors: DataFrame, topic_names: DataFrame, doc_types: DataFrame, standards: DataFrame) -> DataFrame:
    """(kind, query): templates filled with each vendor and topic, left out where nothing was filled; for each template every
    topic with every type of document; each standard. Catalogs are small tables, whose products are the plan."""
    filled = F.replace(F.replace(F.col("template"), F.lit("{vendor}"), F.col("vendor")), F.lit("{topic}"), F.col("topic"))
    products = patterns.crossJoin(few(vendors)).crossJoin(few(topic_names)).select(F.lit("pattern").alias("kind"), filled.alias("query"), "template").where("query <> template").drop("template")
    typed = patterns.crossJoin(few(topic_names)).crossJoin(few(doc_types)).select(F.lit("type").alias("kind"), F.concat_ws(" ", "topic", "doc_type").alias("query"))
    return products.unionByName(typed).unionByName(standards.select(F.lit("standard").alias("kind"), F.col("standard").alias("query")))


def capped(plan: DataFrame, by: str, order: str, cap: int) -> DataFrame:
    """At most ``cap`` queries of each adapter, in order."""
    return plan.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_r") <= cap).drop("_r")


def classified(candidates: DataFrame, cache: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Candidates with (relevant, confidence): from the cache, else from the judge, else rejected; approved if relevant at half
    confidence or more."""
    cached = cache.select(key, F.col("relevant").alias("r1"), F.col("confidence").alias("c1"))
    fresh = judged.select(key, F.col("relevant").alias("r2"), F.col("confidence").alias("c2"))
    joined = candidates.join(cached, key, "left").join(fresh, key, "left")
    out = joined.withColumns({"relevant": F.coalesce("r1", "r2", F.lit(False)), "confidence": F.coalesce("c1", "c2", F.lit(0.0)), "origin": F.when(F.col("r1").isNotNull(), "cache").when(F.col("r2").isNotNull(), "judge").otherwise("default")})
    return out.withColumn("approved", F.col("relevant") & (F.col("confidence") >= 0.5)).drop("r1", "c1", "r2", "c2")


def live(cache: DataFrame, now: Column, hours: int) -> DataFrame:
    """Cache rows younger than a time to live."""
    return cache.where(F.col("created_at") > now - F.make_dt_interval(F.lit(0), F.lit(hours)))


# Parts of a topic's name that bring in standards of a category.
STANDARD_CATEGORIES = (
    ("plc", "plc"), ("safety", "safety"), ("network", "networking"), ("cyber", "cybersecurity"), ("security", "cybersecurity"),
    ("robot", "robotics"), ("scada", "scada"), ("hmi", "scada"), ("process", "process"), ("batch", "process"),
    ("manufacturing", "mes"), ("mes", "mes"),
)
PLAN = ("adapter", "query", "source_config", "limit")


def _planned(rows: DataFrame, adapter: str, query: Column, config: Column, limit: int) -> DataFrame:
    return rows.select(F.lit(adapter).alias("adapter"), query.alias("query"), config.alias("source_config"), F.lit(limit).alias("limit"))


def adapter_plan(topic_rows: DataFrame, vendors: DataFrame, standards: DataFrame, programs: DataFrame, sites: DataFrame, filtered: bool = False) -> DataFrame:
    """(adapter, query, source_config, limit) of all adapters but the plain web search. Topics: ord, name, keywords; vendors:
    name, github_org; standards: id, category; programs: institution, program; sites: domain, label. Keywords are taken as
    far as the adapter asks: three, two of at most two words for the question site. Site searches take the first three topics.
    With ``filtered`` only standards of the topics' categories are asked for. Catalogs are small; institutions' queries are
    said once."""
    word = lambda n: topic_rows.select("name", F.explode(F.slice("keywords", 1, n)).alias("kw"))
    name = F.col("name")
    named = topic_rows.where(name != "")
    asked = standards
    if filtered:
        hits = [F.when(F.contains(F.lower("name"), F.lit(part)), F.lit(cat)) for part, cat in STANDARD_CATEGORIES]
        wanted = topic_rows.select(F.explode(F.array(*hits)).alias("category")).where("category is not null").distinct()
        asked = standards.join(wanted, "category", "left_semi")
    short = word(2).where(F.size(F.split(F.trim("kw"), "\\s+")) <= 2)
    paired = programs.crossJoin(few(topic_rows.select("name"))).withColumn("q", F.trim(F.concat_ws(" ", "program", "name")))
    once = paired.groupBy("q").agg(F.min(F.struct("institution", "program")).alias("p"))
    scoped = sites.where(F.col("domain") != "").crossJoin(few(topic_rows.where("ord < 3").select("name")))
    parts = [
        _planned(word(3), "github", F.col("kw"), F.concat(F.lit("topics/"), "name"), 10),
        _planned(vendors.where(F.col("github_org") != ""), "github", F.concat(F.lit("org:"), "github_org"), F.concat(F.lit("vendors/"), "name"), 10),
        _planned(topic_rows, "rss", name, F.concat(F.lit("topics/"), "name"), 20),
        _planned(named, "academic", name, F.concat(F.lit("academic/topic/"), "name"), 10),
        _planned(word(3), "academic", F.col("kw"), F.concat(F.lit("academic/keyword/"), "kw"), 5),
        _planned(asked, "academic", F.col("id"), F.concat(F.lit("academic/standards/"), "id"), 5),
        _planned(once, "institution", F.col("q"), F.concat(F.lit("institution/"), F.col("p.institution"), F.lit("/"), F.col("p.program")), 5),
        _planned(named, "stackoverflow", name, F.concat(F.lit("stackoverflow/"), "name"), 10),
        _planned(short, "stackoverflow", F.col("kw"), F.concat(F.lit("stackoverflow/"), "name", F.lit("/"), "kw"), 5),
        _planned(scoped, "web", F.concat("name", F.lit(" manufacturing automation")), F.concat(F.lit("site_search/"), F.coalesce("label", "domain")), 5),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ingestion_records(approved: DataFrame, started: Column) -> DataFrame:
    """Flat rows for the content table of candidates with their classification and raw metadata (structs ``classification``
    and ``raw``); a feed's URL only for podcasts and feeds."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    k, raw = F.col("classification"), F.col("raw")
    return approved.select(
        "url", "title", empty(F.col("publisher")).alias("publisher"), "source_type", empty(F.col("snippet")).alias("snippet"),
        "adapter", empty(F.col("query_used")).alias("query_used"), k["doc_type"].alias("doc_type"),
        k["confidence"].alias("confidence"), k["reason"].alias("reason"),
        F.coalesce(k["topic_tags"], F.array().cast("array<string>")).alias("topic_tags"),
        F.coalesce(F.nullif(k["authority_guess"], F.lit("")), F.lit("unknown")).alias("authority"), started.alias("discovered_at"),
        F.when(F.col("source_type").isin("podcast", "rss"), raw["feed_url"]).alias("feed_url"),
        empty(raw["provider"]).alias("provider"), empty(raw["pdf_url"]).alias("pdf_url"),
    )


def cache_stats(cache: DataFrame, key: str, results: str) -> DataFrame:
    """Entries and results of each key."""
    return cache.groupBy(key).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(results), F.lit(0)).alias("results"))
