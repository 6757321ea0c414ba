"""Queries of the corpus, signal and operations analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.operators import aggregates as A
from lexforge.registry import query
from lexforge.sources.views import view, with_views

c = F.col


def content(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "content")


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "signals")


def bigint(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


TOTALS = """
SELECT count(*) AS total, count_if(extraction_status = 'completed') AS extracted, count_if(extraction_status = 'failed') AS extraction_failed,
  count_if(extraction_status = 'pending') AS extraction_pending, count_if(extraction_status = 'completed' AND screening_status = 'dq_rejected') AS dq_rejected,
  count_if(extraction_status = 'completed' AND screening_status = 'approved') AS approved, count_if(extraction_status = 'completed' AND screening_status = 'rejected') AS llm_rejected,
  count_if(extraction_status = 'completed' AND screening_status = 'approved' AND vectorization_status = 'completed') AS vectorized, count_if(signal_processed) AS signal_processed
FROM content"""
TOTAL_NAMES = ("total", "extracted", "extraction_failed", "extraction_pending", "dq_rejected", "approved", "llm_rejected", "vectorized", "signal_processed")


def _over_totals(select: str) -> str:
    return with_views("content", then="SELECT 1").removesuffix("SELECT 1").rstrip() + f", t AS (SELECT {bigint(*TOTAL_NAMES)} FROM ({TOTALS})), p AS (SELECT *, extracted - dq_rejected AS dq_passed FROM t) {select}"


@query("e01_funnel_totals", _over_totals("SELECT * FROM t"))
def e01(spark, sf):
    return A.funnel_totals(content(spark, sf))


@query(
    "e02_funnel_rates",
    _over_totals("""SELECT dq_passed, coalesce(round(extracted / nullif(total, 0), 2) * 100, 0) AS extraction_rate, coalesce(round(dq_passed / nullif(extracted, 0), 2) * 100, 0) AS dq_pass_rate,
    coalesce(round(approved / nullif(dq_passed, 0), 2) * 100, 0) AS acceptance_rate, coalesce(dq_rejected / nullif(extracted, 0) * 100, 0) AS dq_rejected_share, coalesce(llm_rejected / nullif(dq_passed, 0) * 100, 0) AS llm_rejected_share FROM p"""),
)
def e02(spark, sf):
    return A.funnel_rates(A.funnel_totals(content(spark, sf)))


@query(
    "e03_funnel",
    _over_totals("SELECT 1 AS ord, 'Downloaded' AS stage, total AS n FROM p UNION ALL SELECT 2, 'Extracted', extracted FROM p UNION ALL SELECT 3, 'DQ passed', dq_passed FROM p UNION ALL SELECT 4, 'Approved', approved FROM p UNION ALL SELECT 5, 'Vectorized', vectorized FROM p"),
)
def e03(spark, sf):
    return A.funnel(A.funnel_totals(content(spark, sf)))


@query(
    "x05_flow_links",
    _over_totals("""SELECT source, target, value, kind, value / greatest(total, 1) * 100 AS share FROM (
    SELECT 'Downloaded' AS source, 'Extracted' AS target, extracted AS value, 'keep' AS kind, total FROM p UNION ALL SELECT 'Downloaded', 'Extraction failed', extraction_failed, 'drop', total FROM p
    UNION ALL SELECT 'Downloaded', 'Extraction pending', extraction_pending, 'wait', total FROM p UNION ALL SELECT 'Extracted', 'DQ passed', dq_passed, 'keep', total FROM p
    UNION ALL SELECT 'Extracted', 'DQ rejected', dq_rejected, 'drop', total FROM p UNION ALL SELECT 'DQ passed', 'Approved', approved, 'keep', total FROM p UNION ALL SELECT 'DQ passed', 'LLM rejected', llm_rejected, 'drop', total FROM p)"""),
)
def x05(spark, sf):
    return A.flow_links(A.funnel_totals(content(spark, sf)))


FORMAT = """count(*) AS n, count_if(screening_status = 'approved') AS approved, count_if(screening_status = 'rejected') AS llm_rejected, count_if(screening_status = 'dq_rejected') AS dq_rejected,
count_if(extraction_status = 'failed') AS extraction_failed, round(avg(file_size_mb), 6) AS avg_size FROM content"""


@query("e04_by_format", with_views("content", then=f"SELECT content_type, {FORMAT} GROUP BY content_type"))
def e04(spark, sf):
    return A.by_format(content(spark, sf), "content_type")


@query("e13_type_breakdown", with_views("content", then=f"SELECT content_type, source_type, {FORMAT} GROUP BY ALL"))
def e13(spark, sf):
    return A.by_format(content(spark, sf), "content_type", "source_type")


@query("e13_type_rollup", with_views("content", then="SELECT content_type, source_type, count(*) AS n FROM content GROUP BY ROLLUP (content_type, source_type)"))
def e13_rollup(spark, sf):
    """Beyond the reference: subtotals."""
    return content(spark, sf).rollup("content_type", "source_type").agg(F.count(F.lit(1)).alias("n"))


@query("e36_survival", with_views("content", then="SELECT content_type, count(*) AS n, count_if(screening_status = 'approved') AS approved, count_if(screening_status = 'approved') / count(*) * 100 AS survival, 100 - count_if(screening_status = 'approved') / count(*) * 100 AS drop_off FROM content GROUP BY 1"))
def e36(spark, sf):
    n = A.by_format(content(spark, sf), "content_type").select("content_type", "n", "approved")
    return n.withColumn("survival", c("approved") / c("n") * 100).withColumn("drop_off", 100 - c("survival"))


@query("e05_rejection_reasons", with_views("content", then="SELECT screening_reason, count(*) AS n FROM content WHERE screening_reason IS NOT NULL AND screening_status IN ('rejected', 'dq_rejected') GROUP BY 1 ORDER BY n DESC, screening_reason LIMIT 20"))
def e05(spark, sf):
    rejected = content(spark, sf).where(c("screening_reason").isNotNull() & c("screening_status").isin("rejected", "dq_rejected"))
    return A.top(rejected, ["screening_reason"], 20)


@query("e32_gate_failures", with_views("content", then="SELECT string_split(screening_reason, ' (')[1] AS tag, count(*) AS n FROM content WHERE screening_reason LIKE '[quality_gate]%' GROUP BY 1"))
def e32(spark, sf):
    gated = content(spark, sf).where(c("screening_reason").like("[quality_gate]%"))
    return gated.groupBy(F.substring_index("screening_reason", " (", 1).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("e35_rejection_categories", with_views("content", then="SELECT CASE WHEN contains(screening_reason, 'too_short') THEN 'Too short' WHEN contains(screening_reason, 'toxic') THEN 'Toxic' WHEN contains(screening_reason, 'quality') THEN 'Quality' ELSE 'Uncategorized' END AS category, count(*) AS n FROM content WHERE screening_reason IS NOT NULL GROUP BY 1"))
def e35(spark, sf):
    reason = c("screening_reason")
    category = A.ladder(reason, [(reason.contains("too_short"), "Too short"), (reason.contains("toxic"), "Toxic"), (reason.contains("quality"), "Quality")], "Uncategorized")
    return content(spark, sf).where(reason.isNotNull()).groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("e06_signal_types", with_views("signals", then="SELECT signal_type, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM signals GROUP BY 1"))
def e06(spark, sf):
    return signals(spark, sf).groupBy("signal_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))


@query("e07_top_entities", with_views("signals", then="SELECT entity, signal_type, count(*) AS n FROM signals WHERE entity IS NOT NULL AND entity <> '' GROUP BY ALL ORDER BY n DESC, entity, signal_type LIMIT 80"))
def e07(spark, sf):
    return A.top(signals(spark, sf).where((c("entity") != "")), ["entity", "signal_type"], 80)


@query("e08_confidence_buckets", with_views("signals", then="SELECT CASE WHEN confidence >= 0.9 THEN '0.90-1.00' WHEN confidence >= 0.7 THEN '0.70-0.89' WHEN confidence >= 0.5 THEN '0.50-0.69' WHEN confidence >= 0.3 THEN '0.30-0.49' ELSE '<0.30' END AS bucket, count(*) AS n FROM signals GROUP BY 1"))
def e08(spark, sf):
    bucket = A.at_least(c("confidence"), [(0.9, "0.90-1.00"), (0.7, "0.70-0.89"), (0.5, "0.50-0.69"), (0.3, "0.30-0.49")], "<0.30")
    return signals(spark, sf).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("e09_signal_density", with_views("signals", "parents", then="SELECT c.id, count(*) AS n, CAST(floor(any_value(c.size) / 5) AS BIGINT) AS words, round(count(*) / nullif(any_value(c.size) / 5 / 1000, 0), 2) AS density FROM parents c JOIN signals s ON s.source_content_id = c.id GROUP BY c.id"))
def e09(spark, sf):
    """Signals per thousand words; a document's words are estimated from its size."""
    counts = signals(spark, sf).groupBy(c("source_content_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    words = c("size") / 5
    return view(spark, sf, "parents").join(counts, "id").select("id", "n", F.floor(words).alias("words"), F.round(c("n") / F.nullif(words / 1000, F.lit(0.0)), 2).alias("density"))


@query("e10_industries", with_views("signals", then="SELECT industry, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM signals WHERE industry <> '' GROUP BY 1 ORDER BY n DESC, industry LIMIT 30"))
def e10(spark, sf):
    return A.top(signals(spark, sf).where(c("industry") != ""), ["industry"], 30, "n", F.round(F.avg("confidence"), 6).alias("avg_confidence"))


@query("e11_source_yield", with_views("signals", "parents", then="SELECT c.source_name, count(DISTINCT c.id) AS documents, count(s.id) AS n, round(avg(s.confidence), 6) AS avg_confidence FROM parents c JOIN signals s ON s.source_content_id = c.id GROUP BY 1 ORDER BY n DESC, source_name LIMIT 25"))
def e11(spark, sf):
    """Signals are first counted by document, so that the distinct count needs no second expansion of rows."""
    counts = signals(spark, sf).groupBy(c("source_content_id").alias("id")).agg(F.count("id").alias("n"), F.sum("confidence").alias("s"), F.count("confidence").alias("k"))
    by_source = view(spark, sf, "parents").join(counts, "id").groupBy("source_name").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("k"), 6).alias("avg_confidence"))
    return by_source.orderBy(F.desc("n"), "source_name").limit(25)


@query("e12_impact", with_views("signals", then="SELECT impact_level, count(*) AS n FROM signals WHERE impact_level <> '' GROUP BY 1"))
def e12(spark, sf):
    return signals(spark, sf).where(c("impact_level") != "").groupBy("impact_level").agg(F.count(F.lit(1)).alias("n"))


@query("e14_hardware", with_views("content", then="SELECT extraction_hardware, content_type, count(*) AS n FROM content GROUP BY ALL"))
def e14(spark, sf):
    return content(spark, sf).groupBy("extraction_hardware", "content_type").agg(F.count(F.lit(1)).alias("n"))


@query("e15_top_sources", with_views("content", then="SELECT source_name, count(*) AS n, count_if(screening_status = 'approved') AS approved, count_if(screening_status = 'rejected') AS rejected FROM content WHERE source_name <> '' GROUP BY 1 ORDER BY n DESC, source_name LIMIT 30"))
def e15(spark, sf):
    return A.top(content(spark, sf).where(c("source_name") != ""), ["source_name"], 30, "n", A.n_where(c("screening_status") == "approved").alias("approved"), A.n_where(c("screening_status") == "rejected").alias("rejected"))


@query("e37_source_acceptance", with_views("content", then="SELECT source_name, n, approved, n - approved AS rejected, round(approved / n * 100) AS acceptance FROM (SELECT source_name, count(*) AS n, count_if(screening_status = 'approved') AS approved FROM content GROUP BY 1 ORDER BY n DESC, source_name LIMIT 20)"))
def e37(spark, sf):
    best = A.top(content(spark, sf), ["source_name"], 20, "n", A.n_where(c("screening_status") == "approved").alias("approved"))
    return best.select("source_name", "n", "approved", (c("n") - c("approved")).alias("rejected"), F.round(c("approved") / c("n") * 100).alias("acceptance"))


@query("e16_size_buckets", with_views("content", then="SELECT CASE WHEN file_size_mb < 1 THEN '<1' WHEN file_size_mb < 5 THEN '1-5' WHEN file_size_mb < 20 THEN '5-20' WHEN file_size_mb < 50 THEN '20-50' ELSE '50+' END AS bucket, count(*) AS n FROM content WHERE file_size_mb IS NOT NULL GROUP BY 1"))
def e16(spark, sf):
    bucket = A.below(c("file_size_mb"), [(1, "<1"), (5, "1-5"), (20, "5-20"), (50, "20-50")], "50+")
    return content(spark, sf).where(c("file_size_mb").isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("e17_languages", with_views("content", then="SELECT language, count(*) AS n FROM content WHERE language <> '' GROUP BY 1"))
def e17(spark, sf):
    return content(spark, sf).where(c("language") != "").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query("e18_age_buckets", with_views("content", then="SELECT CASE WHEN created_at > TIMESTAMP '2024-02-04 00:00:00' THEN 'Last 7 days' WHEN created_at > TIMESTAMP '2024-01-12 00:00:00' THEN 'Last 30 days' WHEN created_at > TIMESTAMP '2023-11-13 00:00:00' THEN 'Last 90 days' ELSE 'Older' END AS bucket, count(*) AS n FROM content GROUP BY 1"))
def e18(spark, sf):
    """The present is a parameter: 2024-02-11."""
    now = F.expr("TIMESTAMP_NTZ '2024-02-11 00:00:00'")
    ages = [(c("created_at") > now - F.expr(f"INTERVAL {d} DAYS"), f"Last {d} days") for d in (7, 30, 90)]
    return content(spark, sf).groupBy(A.ladder(c("created_at"), ages, "Older").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


DAY = "strftime(created_at, '%Y-%m-%d')"


@query("e19_daily_by_type", with_views("content", then=f"SELECT {DAY} AS day, content_type, count(*) AS n FROM content GROUP BY ALL"))
def e19(spark, sf):
    return content(spark, sf).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "content_type").agg(F.count(F.lit(1)).alias("n"))


@query("e19_daily_signals", with_views("signals", then="SELECT strftime(extracted_at, '%Y-%m-%d') AS day, signal_type, count(*) AS n FROM signals GROUP BY ALL"))
def e19_signals(spark, sf):
    return signals(spark, sf).groupBy(F.date_format("extracted_at", "yyyy-MM-dd").alias("day"), "signal_type").agg(F.count(F.lit(1)).alias("n"))


@query("e20_daily_decisions", with_views("content", then=f"SELECT {DAY} AS day, count_if(screening_status = 'approved') AS approved, count_if(screening_status IN ('rejected', 'dq_rejected')) AS rejected FROM content GROUP BY 1"))
def e20(spark, sf):
    return content(spark, sf).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(A.n_where(c("screening_status") == "approved").alias("approved"), A.n_where(c("screening_status").isin("rejected", "dq_rejected")).alias("rejected"))


@query("f01_running_total", with_views("content", then=f"SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS running FROM (SELECT {DAY} AS day, count(*) AS n FROM content GROUP BY 1)"))
def f01(spark, sf):
    """Daily totals and their cumulative sum (E21, F1)."""
    return A.running_total(content(spark, sf).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n")), "day", "n")


RUNS = "SELECT run_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events, count_if(level IN ('ERROR', 'CRITICAL')) AS errors, count_if(level = 'WARNING') AS warnings FROM system_logs GROUP BY 1 ORDER BY first_ts DESC, run_id LIMIT 20"


def runs(spark, sf):
    logs = view(spark, sf, "system_logs").groupBy("run_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"), A.n_where(c("level").isin("ERROR", "CRITICAL")).alias("errors"), A.n_where(c("level") == "WARNING").alias("warnings"))
    return logs.orderBy(F.desc("first_ts"), "run_id").limit(20)


@query("e22_run_summary", with_views("system_logs", then=f"SELECT run_id, strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_ts, events, errors, warnings FROM ({RUNS})"))
def e22(spark, sf):
    return runs(spark, sf).withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in ("first_ts", "last_ts")})


@query("x01_run_status", with_views("system_logs", then=f"SELECT run_id, CASE WHEN errors > 0 THEN 'ERRORS' ELSE 'OK' END AS status FROM ({RUNS})"))
def x01(spark, sf):
    return runs(spark, sf).select("run_id", F.when(c("errors") > 0, "ERRORS").otherwise("OK").alias("status"))


@query("x02_log_page", with_views("system_logs", then="SELECT id, level, action FROM system_logs WHERE level = 'ERROR' ORDER BY ts DESC, id DESC LIMIT 100"))
def x02(spark, sf):
    return view(spark, sf, "system_logs").where(c("level") == "ERROR").orderBy(F.desc("ts"), F.desc("id")).limit(100).select("id", "level", "action")


@query("e23_recent_errors", with_views("system_logs", then="SELECT source, action, count(*) AS n FROM system_logs WHERE level IN ('ERROR', 'CRITICAL') AND ts > TIMESTAMP '2024-01-20 00:00:00' GROUP BY ALL"))
def e23(spark, sf):
    """Seven days up to a present that is a parameter."""
    recent = view(spark, sf, "system_logs").where(c("level").isin("ERROR", "CRITICAL") & (c("ts") > F.expr("TIMESTAMP_NTZ '2024-01-27 00:00:00' - INTERVAL 7 DAYS")))
    return recent.groupBy("source", "action").agg(F.count(F.lit(1)).alias("n"))


@query("e24_run_details", with_views("system_logs", then="SELECT run_id, CAST(sum(coalesce(CAST(json_extract_string(details_json, '$.raw') AS BIGINT), CAST(json_extract_string(details_json, '$.k') AS BIGINT), 0)) AS BIGINT) AS found, count(*) AS events FROM system_logs GROUP BY 1"))
def e24(spark, sf):
    """A counter in the details under either of two names, else 0."""
    details = F.from_json("details_json", "raw bigint, k bigint")
    found = F.coalesce(details["raw"], details["k"], F.lit(0))
    return view(spark, sf, "system_logs").groupBy("run_id").agg(F.sum(found).alias("found"), F.count(F.lit(1)).alias("events"))


@query("e25_duplicate_hashes", with_views("content", then="SELECT content_hash, count(*) AS n FROM content GROUP BY 1 HAVING count(*) > 1"))
def e25(spark, sf):
    return content(spark, sf).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("e26_overall", with_views("content", then="SELECT count(*) AS n, count(DISTINCT source_type) AS source_types, round(avg(file_size_mb), 6) AS avg_size, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS latest FROM content"))
def e26(spark, sf):
    return content(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_type").alias("source_types"), F.round(F.avg("file_size_mb"), 6).alias("avg_size"), F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


SEARCHABLE = "screening_status = 'approved' AND extraction_status IN ('completed', 'NA') AND NOT coalesce(do_not_vectorize, false) AND transcript <> ''"


def searchable():
    """What a corpus search may see (C2)."""
    return (c("screening_status") == "approved") & c("extraction_status").isin("completed", "NA") & ~F.coalesce(c("do_not_vectorize"), F.lit(False)) & (c("transcript") != "")


@query(
    "e27_inventory",
    with_views("content", then=f"SELECT kind, name, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS r FROM (SELECT 'type' AS kind, coalesce(nullif(content_type, ''), 'unknown') AS name, count(*) AS n FROM content WHERE {SEARCHABLE} GROUP BY 2 UNION ALL SELECT 'language', coalesce(nullif(language, ''), 'unknown'), count(*) FROM content WHERE {SEARCHABLE} GROUP BY 2 UNION ALL SELECT 'source', coalesce(nullif(source_name, ''), 'unknown'), count(*) FROM content WHERE {SEARCHABLE} GROUP BY 2)) WHERE r <= 15"),
)
def e27(spark, sf):
    """Value counts of several columns in one pass: grouping sets by an exploded (kind, name)."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.nullif(c(x), F.lit("")), F.lit("unknown")).alias("name")) for k, x in (("type", "content_type"), ("language", "language"), ("source", "source_name"))])
    counts = content(spark, sf).where(searchable()).select(F.inline(kinds)).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name"))).where("r <= 15").drop("r")


HEALTH = """, d AS (SELECT source_url, adapter, count(*) AS attempts, sum(success) AS ok, count_if(error_type = '403') AS blocked FROM attempts GROUP BY ALL),
s AS (SELECT source_url, adapter, sum(approved) AS approved, sum(rejected) AS rejected FROM attempts WHERE approved + rejected > 0 GROUP BY ALL),
h AS (SELECT coalesce(d.source_url, s.source_url) AS source_url, coalesce(d.adapter, s.adapter) AS adapter, CAST(coalesce(attempts, 0) AS BIGINT) AS attempts, CAST(coalesce(ok, 0) AS BIGINT) AS ok, CAST(coalesce(approved, 0) AS BIGINT) AS approved, CAST(coalesce(rejected, 0) AS BIGINT) AS rejected,
  coalesce(round(ok / nullif(attempts, 0), 2), 0) AS success_rate, coalesce(round(blocked / nullif(attempts, 0), 2), 0) AS blocked_rate, round(approved / nullif(approved + rejected, 0), 2) AS approval_rate
FROM d FULL OUTER JOIN s ON d.source_url IS NOT DISTINCT FROM s.source_url AND d.adapter IS NOT DISTINCT FROM s.adapter)"""


def health(spark, sf):
    """Download and discovery figures of each source: full outer on the keys of both."""
    a = view(spark, sf, "attempts")
    downloads = a.groupBy("source_url", "adapter").agg(F.count(F.lit(1)).alias("attempts"), F.sum("success").cast("long").alias("ok"), A.n_where(c("error_type") == "403").alias("blocked"))
    found = a.where(c("approved") + c("rejected") > 0).groupBy(c("source_url").alias("u"), c("adapter").alias("a")).agg(F.sum("approved").cast("long").alias("approved"), F.sum("rejected").cast("long").alias("rejected"))
    both = downloads.join(found, c("source_url").eqNullSafe(c("u")) & c("adapter").eqNullSafe(c("a")), "full_outer")
    zero = lambda x: F.coalesce(x, F.lit(0))
    return both.select(
        F.coalesce("source_url", "u").alias("source_url"),
        F.coalesce("adapter", "a").alias("adapter"),
        *[zero(c(n)).alias(n) for n in ("attempts", "ok", "approved", "rejected")],
        F.coalesce(F.round(c("ok") / F.nullif(c("attempts"), F.lit(0)), 2), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.round(c("blocked") / F.nullif(c("attempts"), F.lit(0)), 2), F.lit(0.0)).alias("blocked_rate"),
        F.round(c("approved") / F.nullif(c("approved") + c("rejected"), F.lit(0)), 2).alias("approval_rate"),
    )


@query("e28_source_health", with_views("attempts", then="SELECT 1").removesuffix("SELECT 1").rstrip() + HEALTH + " SELECT *, blocked_rate >= 0.5 OR (approved + rejected >= 5 AND approval_rate < 0.2) AS flagged FROM h")
def e28(spark, sf):
    flagged = (c("blocked_rate") >= 0.5) | ((c("approved") + c("rejected") >= 5) & (c("approval_rate") < 0.2))
    return health(spark, sf).withColumn("flagged", flagged)


@query("e29_flagged_sources", with_views("attempts", then="SELECT 1").removesuffix("SELECT 1").rstrip() + HEALTH + " SELECT source_url, adapter FROM h WHERE blocked_rate >= 0.5 OR approval_rate <= 1 - CAST(0.8 AS DOUBLE)")
def e29(spark, sf):
    return health(spark, sf).where((c("blocked_rate") >= 0.5) | (c("approval_rate") <= 1 - 0.8)).select("source_url", "adapter")


@query("e31_tally", with_views("attempts", then="SELECT coalesce(nullif(source_url, 'u0'), adapter) AS key, CAST(sum(approved) AS BIGINT) AS approved, CAST(sum(rejected) AS BIGINT) AS rejected FROM attempts GROUP BY 1"))
def e31(spark, sf):
    """Keyed by the first name that is there."""
    return view(spark, sf, "attempts").groupBy(F.coalesce(F.nullif(c("source_url"), F.lit("u0")), c("adapter")).alias("key")).agg(F.sum("approved").cast("long").alias("approved"), F.sum("rejected").cast("long").alias("rejected"))


@query("e33_rejected_impact", with_views("content", "signals", then="SELECT substring(c.screening_reason, 1, 40) AS reason, count(DISTINCT c.id) AS documents, count(*) AS signals FROM content c JOIN signals s ON s.source_content_id = c.id WHERE c.screening_status IN ('rejected', 'dq_rejected') GROUP BY 1"))
def e33(spark, sf):
    """Signals of rejected documents by reason: one aggregate join for what was a lookup per row."""
    counts = signals(spark, sf).groupBy(c("source_content_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rejected = content(spark, sf).where(c("screening_status").isin("rejected", "dq_rejected"))
    return rejected.join(counts, "id").groupBy(F.substring("screening_reason", 1, 40).alias("reason")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("signals"))


@query("e34_cleanup_summary", with_views("content", then="SELECT coalesce(screening_reason, 'none') AS reason, count(*) AS files, round(sum(file_size_mb), 3) AS mb FROM content WHERE screening_status IN ('rejected', 'dq_rejected') GROUP BY 1"))
def e34(spark, sf):
    return content(spark, sf).where(c("screening_status").isin("rejected", "dq_rejected")).groupBy(F.coalesce("screening_reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("file_size_mb"), 3).alias("mb"))


@query("e40_source_types", with_views("content", then="SELECT source_type, count(*) AS n, count_if(extraction_status = 'completed') AS extracted, count_if(screening_status = 'approved') AS approved, count_if(vectorization_status = 'completed') AS vectorized FROM content GROUP BY 1"))
def e40(spark, sf):
    return content(spark, sf).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), A.n_where(c("extraction_status") == "completed").alias("extracted"), A.n_where(c("screening_status") == "approved").alias("approved"), A.n_where(c("vectorization_status") == "completed").alias("vectorized"))


@query("x06_composition", with_views("content", then="SELECT content_type, n, n / sum(n) OVER () * 100 AS share FROM (SELECT content_type, count(*) AS n FROM content GROUP BY 1)"))
def x06(spark, sf):
    return A.with_total_share(content(spark, sf).groupBy("content_type").agg(F.count(F.lit(1)).alias("n")), "n")


@query("x09_status_counts", with_views("content", then="SELECT extraction_status AS status, count(*) AS n FROM content GROUP BY 1"))
def x09(spark, sf):
    return content(spark, sf).groupBy(c("extraction_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("x10_processing_summary", with_views("content", then="SELECT count_if(extraction_status = 'pending') AS pending, count_if(extraction_status = 'completed') AS completed, count_if(extraction_status = 'failed') AS failed, count_if(screening_status = 'approved') AS approved, count_if(screening_status IN ('rejected', 'dq_rejected')) AS rejected, count_if(vectorization_status = 'completed') AS vectorized FROM content"))
def x10(spark, sf):
    e, s, v = c("extraction_status"), c("screening_status"), c("vectorization_status")
    return content(spark, sf).agg(A.n_where(e == "pending").alias("pending"), A.n_where(e == "completed").alias("completed"), A.n_where(e == "failed").alias("failed"), A.n_where(s == "approved").alias("approved"), A.n_where(s.isin("rejected", "dq_rejected")).alias("rejected"), A.n_where(v == "completed").alias("vectorized"))


@query("x12_vectorize_queue", with_views("content", then="SELECT id, title FROM content WHERE vectorization_status = 'pending' AND NOT coalesce(do_not_vectorize, false) ORDER BY created_at DESC, id LIMIT 50"))
def x12(spark, sf):
    return content(spark, sf).where((c("vectorization_status") == "pending") & ~F.coalesce(c("do_not_vectorize"), F.lit(False))).orderBy(F.desc("created_at"), "id").limit(50).select("id", "title")


@query("x14_token_estimate", with_views("content", then="SELECT CAST(sum(length(transcript)) // 4 AS BIGINT) AS tokens FROM content"))
def x14(spark, sf):
    return content(spark, sf).agg(F.expr("sum(length(transcript)) div 4").alias("tokens"))


@query("x16_signals_per_approved", with_views("content", "signals", then="SELECT (SELECT count(*) FROM signals) / nullif((SELECT count_if(screening_status = 'approved') FROM content), 0) AS per_approved"))
def x16(spark, sf):
    n = signals(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    return n.join(content(spark, sf).agg(A.n_where(c("screening_status") == "approved").alias("a")), how="cross").select((c("n") / F.nullif(c("a"), F.lit(0))).alias("per_approved"))


@query("x17_freed_space", with_views("content", then="SELECT count(*) AS files, round(sum(file_size_mb), 3) AS mb FROM content WHERE screening_status = 'rejected'"))
def x17(spark, sf):
    return content(spark, sf).where(c("screening_status") == "rejected").agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("file_size_mb"), 3).alias("mb"))


@query("x18_item", with_views("content", then="SELECT id, title, screening_status FROM content WHERE id = 42"))
def x18(spark, sf):
    return content(spark, sf).where(c("id") == 42).select("id", "title", "screening_status")


@query("x23_cursor", with_views("content", then="SELECT strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS cursor FROM content"))
def x23(spark, sf):
    return content(spark, sf).agg(F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("cursor"))


@query("d01_signals_with_content", with_views("signals", "parents", then="SELECT s.id, s.entity, c.source_name FROM signals s JOIN parents c ON s.source_content_id = c.id WHERE s.confidence >= 0.9"))
def d01(spark, sf):
    return signals(spark, sf).where(c("confidence") >= 0.9).select("id", "entity", "source_content_id").join(view(spark, sf, "parents").select(c("id").alias("source_content_id"), "source_name"), "source_content_id").drop("source_content_id")


@query("d02_content_metadata", with_views("content", then="SELECT c.id, c.language, coalesce(b.quality, -1) AS quality, coalesce(b.toxic, -1) AS toxic FROM content c LEFT JOIN labels b ON c.id = b.doc_id"))
def d02(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("doc_id", "id")
    return content(spark, sf).select("id", "language").join(labels, "id", "left").select("id", "language", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("d03_cooccurrence", with_views("signals", then="SELECT a.entity AS entity_a, b.entity AS entity_b, count(*) AS n FROM signals a JOIN signals b ON a.source_content_id = b.source_content_id AND a.entity < b.entity GROUP BY ALL ORDER BY n DESC, entity_a, entity_b LIMIT 100"))
def d03(spark, sf):
    return A.cooccurrence(signals(spark, sf), "entity", "source_content_id", 100)


@query("d08_matching_items", with_views("content", then="SELECT id FROM content WHERE content_hash IN (SELECT content_hash FROM content WHERE id % 10 = 0) OR lower(title) IN (SELECT lower(title) FROM content WHERE id % 10 = 1)"))
def d08(spark, sf):
    """Link or title: two semi joins, so that no OR turns the join into a nested loop."""
    all_ = content(spark, sf).select("id", "content_hash", F.lower("title").alias("t"))
    links = all_.where("id % 10 = 0").select("content_hash").distinct()
    titles = all_.where("id % 10 = 1").select("t").distinct()
    return all_.join(links, "content_hash", "left_semi").select("id").unionByName(all_.join(titles, "t", "left_semi").select("id")).distinct()


@query("d13_signal_context", with_views("content", "signals", then="SELECT s.id, md5(c.transcript) AS transcript FROM signals s JOIN content c ON s.source_content_id = c.id"))
def d13(spark, sf):
    return signals(spark, sf).select("id", c("source_content_id").alias("cid")).join(content(spark, sf).select(c("id").alias("cid"), F.md5(c("transcript").cast("binary")).alias("transcript")), "cid").drop("cid")


@query("f02_keep_newest", with_views("content", then="SELECT id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY created_at DESC, id DESC) AS r FROM content) WHERE r > 1"))
def f02(spark, sf):
    """All but the newest of each hash, by one aggregate of the newest and a join, not by a window over a hash's copies."""
    all_ = content(spark, sf).select("id", "content_hash", "created_at")
    newest = all_.groupBy("content_hash").agg(F.max(F.struct("created_at", "id")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1").select("content_hash", c("m.id").alias("newest"))
    return all_.join(newest, "content_hash").where("id <> newest").select("id", "content_hash")


@query("f07_recent_turns", "SELECT conv_id, n, role, text FROM (SELECT conv_id, role, substring(text, 1, 80) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n0, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, least(3, count(*) OVER (PARTITION BY conv_id)) + 1 - row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE back <= 3")
def f07(spark, sf):
    """Last three turns of a conversation, numbered from 1."""
    w = Window.partitionBy("conv_id")
    ranked = view(spark, sf, "turns").withColumn("back", F.row_number().over(w.orderBy(F.desc("turn")))).where("back <= 3")
    return ranked.select("conv_id", (F.count(F.lit(1)).over(w) + 1 - c("back")).alias("n"), "role", F.substring("text", 1, 80).alias("text"))


@query("f06_last_user_turn", "SELECT conv_id, max(turn) FILTER (role = 'user') AS turn FROM conversations GROUP BY 1")
def f06(spark, sf):
    """Most recent turn that matches a condition."""
    return view(spark, sf, "turns").groupBy("conv_id").agg(F.max(F.when(c("role") == "user", c("turn"))).alias("turn"))


@query("x08_session_metrics", "SELECT role, count(*) AS n, round(avg(length(text)), 6) AS avg_chars FROM conversations GROUP BY 1")
def x08(spark, sf):
    return view(spark, sf, "turns").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 6).alias("avg_chars"))


@query("g02_page", with_views("content", then="SELECT id, title FROM content ORDER BY created_at DESC, id LIMIT 25 OFFSET 50"))
def g02(spark, sf):
    return content(spark, sf).select("id", "title", "created_at").orderBy(F.desc("created_at"), "id").offset(50).limit(25).drop("created_at")


@query("g03_keyset_page", with_views("content", then="SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS ts FROM content WHERE created_at > TIMESTAMP '2024-01-10 00:00:00' ORDER BY created_at, id LIMIT 100"))
def g03(spark, sf):
    page = content(spark, sf).where(c("created_at") > F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")).orderBy("created_at", "id").limit(100)
    return page.select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("g08_shortest", with_views("content", then="SELECT id, length(transcript) AS n FROM content ORDER BY n, id LIMIT 50"))
def g08(spark, sf):
    return content(spark, sf).select("id", F.length("transcript").cast("long").alias("n")).orderBy("n", "id").limit(50)


@query("c03_pending_extraction", with_views("content", then="SELECT id FROM content WHERE extraction_status = 'pending' AND content_type = 'pdf'"))
def c03(spark, sf):
    return content(spark, sf).where((c("extraction_status") == "pending") & (c("content_type") == "pdf")).select("id")


@query("c04_pending_screening", with_views("content", then="SELECT id FROM content WHERE (screening_status = 'pending' OR screening_status IS NULL) AND extraction_status = 'completed' ORDER BY id LIMIT 200"))
def c04(spark, sf):
    return content(spark, sf).where((F.coalesce(c("screening_status"), F.lit("pending")) == "pending") & (c("extraction_status") == "completed")).select("id").orderBy("id").limit(200)


@query("c05_unprocessed", with_views("content", then="SELECT id FROM content WHERE screening_status = 'approved' AND (signal_processed = false OR signal_processed IS NULL)"))
def c05(spark, sf):
    return content(spark, sf).where((c("screening_status") == "approved") & ~F.coalesce(c("signal_processed"), F.lit(False))).select("id")


@query("c06_rejection_report", with_views("content", then="SELECT id, screening_reason FROM content WHERE screening_status = 'rejected' ORDER BY created_at DESC, id LIMIT 50"))
def c06(spark, sf):
    return content(spark, sf).where("screening_status = 'rejected'").orderBy(F.desc("created_at"), "id").limit(50).select("id", "screening_reason")


@query("c02_searchable", with_views("content", then=f"SELECT id FROM content WHERE {SEARCHABLE}"))
def c02(spark, sf):
    return content(spark, sf).where(searchable()).select("id")


@query("c08_title_search", with_views("content", then="SELECT id, title FROM content WHERE contains(lower(title), lower('The'))"))
def c08(spark, sf):
    return content(spark, sf).where(F.lower("title").contains("the")).select("id", "title")


@query("c10_confident_signals", with_views("signals", then="SELECT id, signal_type, confidence FROM signals WHERE confidence >= 0.8"))
def c10(spark, sf):
    return signals(spark, sf).where("confidence >= 0.8").select("id", "signal_type", "confidence")


@query("c11_signal_texts", with_views("signals", then="SELECT id, coalesce(nullif(industry, ''), entity) AS text FROM signals WHERE coalesce(nullif(industry, ''), entity) <> ''"))
def c11(spark, sf):
    return signals(spark, sf).select("id", F.coalesce(F.nullif(c("industry"), F.lit("")), c("entity")).alias("text")).where("text <> ''")
