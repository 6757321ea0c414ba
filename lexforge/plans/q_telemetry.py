"""Queries of the telemetry analytics, and windows over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import telemetry as T
from lexforge.plans.tables import load
from lexforge.registry import query
from lexforge.sources.views import view, with_views


def rows(spark, sf):
    return view(spark, sf, "telemetry")


def over(sql):
    return with_views("telemetry", then=sql)


@query("q01_overview", over("SELECT site, count(*) AS n, count_if(is_anomaly) AS anomalies, round(count_if(is_anomaly) / count(*) * 100, 6) AS percent FROM telemetry GROUP BY 1"))
def q01(spark, sf):
    return T.by_site(rows(spark, sf))


@query("q01_anomaly_types", over("SELECT anomaly_type, count(*) AS n FROM telemetry WHERE is_anomaly GROUP BY 1"))
def q01_types(spark, sf):
    return rows(spark, sf).where("is_anomaly").groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q02_energy",
    over("""SELECT site, round(avg(production_power_w), 6) AS avg_production_power_w, round(avg(consumption_power_w), 6) AS avg_consumption_power_w, round(avg(battery_power_w), 6) AS avg_battery_power_w,
    round(sum(production_power_w) * (1.0::DOUBLE / 60 / 1000), 6) AS production_kwh, round(sum(consumption_power_w) * (1.0::DOUBLE / 60 / 1000), 6) AS consumption_kwh, round(sum(battery_power_w) * (1.0::DOUBLE / 60 / 1000), 6) AS battery_kwh,
    round(avg(battery_soc_pct), 6) AS avg_soc, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM telemetry GROUP BY 1"""),
)
def q02(spark, sf):
    return T.energy(rows(spark, sf))


@query(
    "q03_trend",
    over("""SELECT site, first_half, second_half, CASE WHEN second_half > 1.1 * first_half THEN 'increasing' WHEN second_half < 0.9 * first_half THEN 'decreasing' ELSE 'stable' END AS trend FROM (
    SELECT site, count_if(is_anomaly AND r <= n // 2) AS first_half, count_if(is_anomaly AND r > n // 2) AS second_half FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts, id) AS r, count(*) OVER (PARTITION BY site) AS n FROM telemetry) GROUP BY 1)"""),
)
def q03(spark, sf):
    return T.trend(rows(spark, sf))


@query("q03_top_anomaly", over("SELECT site, anomaly_type, n FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, anomaly_type) AS r FROM (SELECT site, anomaly_type, count(*) AS n FROM telemetry WHERE is_anomaly GROUP BY ALL)) WHERE r = 1"))
def q03_top(spark, sf):
    return T.top_anomaly(rows(spark, sf))


@query("q04_slice", over("SELECT anomaly_type, site, count(*) AS n FROM telemetry WHERE site IN ('site 0', 'site 2') AND anomaly_type IN ('type_1', 'type_3') GROUP BY ALL"))
def q04(spark, sf):
    return rows(spark, sf).where(F.col("site").isin("site 0", "site 2") & F.col("anomaly_type").isin("type_1", "type_3")).groupBy("anomaly_type", "site").agg(F.count(F.lit(1)).alias("n"))


@query("g09_sample_rows", over("(SELECT id, site, is_anomaly FROM telemetry WHERE is_anomaly ORDER BY ts, id LIMIT 5) UNION ALL (SELECT id, site, is_anomaly FROM telemetry WHERE NOT is_anomaly ORDER BY ts, id LIMIT 5)"))
def g09(spark, sf):
    """Five normal and five anomalous readings."""
    first = rows(spark, sf).orderBy("ts", "id").select("id", "site", "is_anomaly")
    return first.where("is_anomaly").limit(5).unionByName(first.where("not is_anomaly").limit(5))


def _series(name, key_sql, group_by, agg, duck):
    ms = ("production_power_w", "consumption_power_w")

    @query(name, over(f"SELECT {key_sql} AS x, " + ", ".join(f"round({duck}({m}), 2) AS {m}" for m in ms) + f" FROM telemetry WHERE {key_sql} IS NOT NULL GROUP BY 1"))
    def run(spark, sf):
        return T.series(rows(spark, sf), group_by, (*ms, "no_such_metric"), agg)


_series("q05_series_site_mean", "site", "site", "mean", "avg")
_series("q05_series_day_sum", "strftime(ts, '%Y-%m-%d')", "day", "sum", "sum")
_series("q05_series_hour_max", "CAST(hour(ts) AS INT)", "hour", "max", "max")
_series("q05_series_anomaly_min", "anomaly_type", "anomaly_type", "min", "min")


@query("q06_text", over("SELECT concat(site, ': ', CAST(n AS STRING), ' readings, ', CAST(a AS STRING), ' anomalies') AS line FROM (SELECT site, count(*) AS n, count_if(is_anomaly) AS a FROM telemetry GROUP BY 1)"))
def q06(spark, sf):
    return T.by_site(rows(spark, sf)).select(F.format_string("%s: %d readings, %d anomalies", "site", "n", "anomalies").alias("line"))


@query("i22_mentions", with_views("telemetry", then="SELECT t.qid, k.kind, k.name FROM (SELECT id AS qid, lower(concat('Readings of ', site, ' with ', replace(anomaly_type, '_', ' '))) AS q FROM telemetry WHERE is_anomaly) t JOIN (SELECT DISTINCT 'site' AS kind, site AS name, string_split(site, ' ')[1] AS needle FROM telemetry UNION SELECT DISTINCT 'anomaly', anomaly_type, anomaly_type FROM telemetry WHERE anomaly_type IS NOT NULL) k ON contains(t.q, k.needle) OR contains(t.q, replace(k.needle, '_', ' '))"))
def i22(spark, sf):
    asked = rows(spark, sf).where("is_anomaly").select(F.col("id").alias("qid"), F.concat(F.lit("Readings of "), "site", F.lit(" with "), F.replace(F.col("anomaly_type"), F.lit("_"), F.lit(" "))).alias("query"))
    return T.mentions(asked, rows(spark, sf))


@query("o08_tumbling", over("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(production_power_w), 4) AS total FROM telemetry GROUP BY 1"))
def o08_tumbling(spark, sf):
    """Beyond the reference: hourly windows."""
    w = rows(spark, sf).groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("production_power_w"), 4).alias("total"))
    return w.select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total")


@query(
    "o08_sessions",
    """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts - prev < INTERVAL '6 hours' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
    FROM (SELECT user_id, event_id, CAST(ts AS TIMESTAMP) AS ts, lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, s""",
)
def o08_sessions(spark, sf):
    """Beyond the reference: sessions of a user that end after six idle hours."""
    s = load(spark, sf, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
