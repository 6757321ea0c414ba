"""The library's data model over the given tables: deterministic views with the state columns that its queries drive on.

Each view has one SQL text; ``{hours}`` and the like stand for the few things that Spark and DuckDB write differently, so
that the oracle reads the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexforge.plans.tables import load

SPARK = {"hours": "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(d.doc_id AS INT), 0, 0)", "key": "CAST(get_json_object(e.props, '$.k') AS BIGINT)", "day": "date_format(e.ts, 'yyyy-MM-dd')", "ts": "CAST(e.ts AS TIMESTAMP_NTZ)", "ship": "CAST(l.l_shipdate AS TIMESTAMP_NTZ)", "title": "regexp_extract(p.html, '<title>(.*?)</title>', 1)"}
DUCK = {"hours": "TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id AS INT))", "key": "CAST(json_extract_string(e.props, '$.k') AS BIGINT)", "day": "strftime(e.ts, '%Y-%m-%d')", "ts": "CAST(e.ts AS TIMESTAMP)", "ship": "CAST(l.l_shipdate AS TIMESTAMP)", "title": "regexp_extract(p.html, '<title>(.*?)</title>', 1)"}

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "content": (
        ("documents", "labels"),
        """
        SELECT d.doc_id AS id, substring(d.text, 1, 60) AS title,
          CASE d.doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'pdf' WHEN 2 THEN 'html' ELSE 'audio' END AS content_type,
          CASE d.doc_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'rss' ELSE 'academic' END AS source_type,
          d.source AS source_name, d.lang AS language, d.text AS transcript, CAST(d.n_chars AS DOUBLE) / 1000 AS file_size_mb,
          md5(d.text) AS content_hash, {hours} AS created_at, CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE '2024-01-02' END AS pub_date,
          CASE d.doc_id % 2 WHEN 0 THEN 'cpu' ELSE 'gpu' END AS extraction_hardware,
          CASE WHEN d.doc_id % 11 = 0 THEN 'failed' WHEN d.doc_id % 13 = 0 THEN 'pending' ELSE 'completed' END AS extraction_status,
          CASE WHEN length(d.text) < 200 THEN 'dq_rejected' WHEN b.quality = 1 THEN 'approved' WHEN b.quality = 0 THEN 'rejected' ELSE 'pending' END AS screening_status,
          CASE WHEN length(d.text) < 200 THEN concat('[quality_gate] too_short (', CAST(length(d.text) AS STRING), ')') WHEN b.quality = 0 AND b.toxic = 1 THEN 'toxic content' WHEN b.quality = 0 THEN 'low quality text' END AS screening_reason,
          CASE d.doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS signal_processed,
          CASE WHEN d.doc_id % 17 = 0 THEN true WHEN d.doc_id % 2 = 0 THEN false END AS do_not_vectorize,
          CASE WHEN b.quality = 0 THEN 'not_applicable' WHEN d.doc_id % 7 < 4 THEN 'completed' WHEN d.doc_id % 7 = 4 THEN 'failed' ELSE 'pending' END AS vectorization_status
        FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id""",
    ),
    "signals": (
        ("lineitem", "part"),
        """
        SELECT l.l_orderkey * 10 + l.l_linenumber AS id, l.l_orderkey AS source_content_id, p.p_name AS entity, p.p_type AS signal_type, p.p_brand AS industry,
          CASE WHEN l.l_discount * 10 > 1 THEN 1.0 ELSE l.l_discount * 10 END AS confidence, l.l_returnflag AS impact_level, {ship} AS extracted_at,
          l.l_linestatus AS line_status
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    ),
    "parents": (("orders",), "SELECT o_orderkey AS id, o_orderpriority AS source_name, o_orderstatus AS source_type, CAST(o_totalprice AS DOUBLE) AS size FROM orders"),
    "system_logs": (
        ("events",),
        """
        SELECT e.event_id AS id, {ts} AS ts, CASE e.event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
          e.event_type AS source, concat('k', CAST({key} % 5 AS STRING)) AS action, concat(CAST(e.user_id AS STRING), '_', {day}) AS run_id, e.props AS details_json
        FROM events e""",
    ),
    "telemetry": (
        ("events",),
        """
        SELECT e.event_id AS id, {ts} AS ts, concat('site ', CAST(e.user_id % 3 AS STRING)) AS site, e.value AS production_power_w, e.value * (e.user_id % 7) AS consumption_power_w,
          e.value - 50 AS battery_power_w, CAST(e.user_id % 101 AS DOUBLE) AS battery_soc_pct, e.event_type = 'error' AS is_anomaly,
          CASE WHEN e.event_type = 'error' THEN concat('type_', CAST(e.user_id % 5 AS STRING)) END AS anomaly_type
        FROM events e""",
    ),
    "attempts": (
        ("events",),
        """
        SELECT e.event_id AS id, concat('u', CAST(e.user_id % 20 AS STRING)) AS source_url, CASE e.user_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'rss' ELSE 'academic' END AS adapter,
          CASE WHEN e.event_type = 'error' THEN 0 ELSE 1 END AS success, CASE WHEN e.event_type = 'error' AND e.event_id % 2 = 0 THEN '403' WHEN e.event_type = 'error' THEN 'timeout' END AS error_type,
          CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END AS approved, CASE WHEN e.event_type = 'view' THEN 1 ELSE 0 END AS rejected
        FROM events e""",
    ),
    "candidates": (("pages",), "SELECT p.page_id AS ord, p.url AS url, {title} AS title, p.html AS html FROM pages p"),
    "turns": (("conversations",), "SELECT conv_id, turn, role, text FROM conversations"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; nothing runs."""
    tables, sql = VIEWS[name]
    text = sql.format(**SPARK)
    frames = {t: load(spark, sf_dir, t) for t in tables}
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **frames)


def with_views(*names: str, then: str) -> str:
    """DuckDB SQL over views."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1].format(**DUCK)})" for n in names) + " " + then
