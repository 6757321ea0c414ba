"""Sensor telemetry: overviews, energy, trends and grouped series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.operators.aggregates import n_where, share
from lexforge.operators.retrieval import meet
from lexforge.plans.tables import materialize

METRICS = ("production_power_w", "consumption_power_w", "battery_power_w", "battery_soc_pct")
KEYS = {"site": "site", "day": "date_format(ts, 'yyyy-MM-dd')", "hour": "hour(ts)", "anomaly_type": "anomaly_type"}
AGGREGATES = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}
#: Watts over one minute in kilowatt hours.
KWH = 1 / 60 / 1000


def by_site(rows: DataFrame) -> DataFrame:
    """Readings, anomalies and their percentage by site."""
    return rows.groupBy("site").agg(F.count(F.lit(1)).alias("n"), n_where(F.col("is_anomaly")).alias("anomalies")).withColumn("percent", F.round(share(F.col("anomalies"), F.col("n")), 6))


def energy(rows: DataFrame) -> DataFrame:
    """Mean power, energy of one-minute readings, mean charge and the range of time by site."""
    power = METRICS[:3]
    means = [F.round(F.avg(m), 6).alias(f"avg_{m}") for m in power]
    sums = [F.round(F.coalesce(F.sum(m), F.lit(0.0)) * KWH, 6).alias(m.replace("_power_w", "_kwh")) for m in power]
    times = [F.date_format(f("ts"), "yyyy-MM-dd HH:mm:ss").alias(n) for f, n in ((F.min, "first_ts"), (F.max, "last_ts"))]
    return rows.groupBy("site").agg(*means, *sums, F.round(F.avg("battery_soc_pct"), 6).alias("avg_soc"), *times)


def trend(rows: DataFrame, up: float = 1.1, down: float = 0.9) -> DataFrame:
    """Anomalies in the first and second half of each site's readings, by time and id. The halves come from a rank that
    is counted in two levels, day and within the day, so no window holds more than a day of a site."""
    day = rows.withColumn("_day", F.to_date("ts"))
    before = Window.partitionBy("site").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = day.groupBy("site", "_day").agg(F.count(F.lit(1)).alias("_n")).select("site", "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("site")).alias("_all"))
    ranked = day.withColumn("_own", F.row_number().over(Window.partitionBy("site", "_day").orderBy("ts", "id")) - 1).join(days, ["site", "_day"])
    first = F.col("_before") + F.col("_own") < F.floor(F.col("_all") / 2)
    halves = ranked.groupBy("site").agg(n_where(first & F.col("is_anomaly")).alias("first_half"), n_where(~first & F.col("is_anomaly")).alias("second_half"))
    change = F.when(F.col("second_half") > up * F.col("first_half"), "increasing").when(F.col("second_half") < down * F.col("first_half"), "decreasing").otherwise("stable")
    return halves.withColumn("trend", change)


def top_anomaly(rows: DataFrame) -> DataFrame:
    """The most frequent anomaly type of each site; ties to the smaller name."""
    counts = rows.where(F.col("is_anomaly") & F.col("anomaly_type").isNotNull()).groupBy("site", "anomaly_type").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("site").agg(F.min(F.struct((-F.col("n")).alias("minus"), "anomaly_type")).alias("b"))
    return best.select("site", F.col("b.anomaly_type").alias("anomaly_type"), (-F.col("b.minus")).alias("n"))


def series(rows: DataFrame, group_by: str, metrics: Sequence[str], agg: str = "mean") -> DataFrame:
    """One row for each key. Unknown metrics are dropped, an unknown key means site, an unknown aggregate means mean; rows
    without a key play no part; sums of nothing are 0. Rounded to 2 places. No metric left: no rows."""
    known = [m for m in metrics if m in METRICS]
    key = KEYS.get(group_by, KEYS["site"])
    f = AGGREGATES.get(agg, F.avg)
    grouped = rows.withColumn("x", F.expr(key)).where("x is not null").groupBy("x")
    values = [F.round(F.coalesce(f(m), F.lit(0.0)) if agg == "sum" else f(m), 2).alias(m) for m in known]
    return grouped.agg(*values) if values else grouped.agg(F.count(F.lit(1)).alias("n")).select("x").limit(0)


def mentions(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(qid, kind, name): sites whose first word, and anomaly types whose name (underscores as blanks, too) a query holds.
    The names are the distinct ones of the dimension columns; blocks of them meet each query."""
    sites = rows.select(F.lit("site").alias("kind"), F.col("site").alias("name")).distinct().withColumn("needle", F.lower(F.element_at(F.split("name", " "), 1)))
    types = rows.where("anomaly_type is not null").select(F.lit("anomaly").alias("kind"), F.col("anomaly_type").alias("name")).distinct().withColumn("needle", F.lower("name"))
    names = materialize(sites.unionByName(types).withColumn("qid", F.concat_ws(":", "kind", "name")))
    met = meet(queries.select(F.col("qid").alias("asked"), F.lower("query").alias("text")), names, ["kind", "name", "needle"])
    said = lambda q: F.contains("text", q["needle"]) | F.contains("text", F.replace(q["needle"], F.lit("_"), F.lit(" ")))
    found = met.select("asked", F.explode(F.filter("qs", lambda q: F.coalesce(said(q), F.lit(False)))).alias("q"))
    return found.select(F.col("asked").alias("qid"), "q.kind", "q.name")
