"""Readers and writers of files: texts, JSON catalogs, feeds, telemetry, sidecars, snapshots and vector tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators.retrieval import normalised

TELEMETRY = "id long, ts timestamp_ntz, site string, production_power_w double, consumption_power_w double, battery_power_w double, battery_soc_pct double, is_anomaly boolean, anomaly_type string"


def text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, stem, text) of whole files: UTF-8, or Latin-1 where the bytes are no UTF-8."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select("path", F.regexp_extract("path", "([^/]+?)(\\.[^./]*)?$", 1).alias("stem"), text.alias("text"))


def with_sidecars(texts: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Files with the metadata of ``<stem>_metadata.json``, null without one."""
    meta = sidecars.withColumn("stem", F.regexp_extract(F.col("path"), "([^/]+)_metadata\\.json$", 1)).drop("path")
    return texts.join(meta, "stem", "left")


def json_catalog(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All JSON documents of a folder, each with the name of its file."""
    reader = spark.read.option("multiLine", "true")
    found = (reader.schema(schema) if schema else reader).json(path)
    return found.select("*", F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)\\.", 1).alias("catalog"))


def feed_items(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(title, link, snippet, pub_date) of the items of RSS files: summary or description, cut to 500 characters; published
    or updated."""
    schema = "title string, link string, summary string, description string, published string, updated string"
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    text = F.coalesce("summary", "description", F.lit(""))
    snippet = F.when(F.length(text) > 500, F.concat(F.substring(text, 1, 500), F.lit("..."))).otherwise(text)
    found = items.select("title", "link", snippet.alias("snippet"), F.coalesce("published", "updated").alias("pub_date"))
    return found if limit is None else found.limit(limit)


def matching(items: DataFrame, keywords: str) -> DataFrame:
    """Items whose title or snippet holds any of the words."""
    text = F.lower(F.concat_ws(" ", "title", "snippet"))
    return items.where(F.exists(F.array(*[F.lit(k) for k in keywords.lower().split()]), lambda k: F.contains(text, k)))


def telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TELEMETRY).option("header", "true").csv(path)


def append_vectors(vectors: DataFrame, path: str, rebuild: bool = False) -> None:
    """Vectors of length one, appended (repeats stay) or in place of what is there."""
    vectors.withColumn("vector", F.transform(normalised(F.col("vector")), lambda x: x.cast("float"))).write.mode("overwrite" if rebuild else "append").parquet(path)


def compact(spark: SparkSession, path: str, target: str, files: int) -> None:
    """The same rows in so many files."""
    spark.read.parquet(path).repartition(files).write.mode("overwrite").parquet(target)


def snapshot(parts: Mapping[str, DataFrame]) -> DataFrame:
    """(name, json): each part's rows as one JSON array, of at most the few hundred rows that a dashboard shows."""
    out = None
    for name, part in parts.items():
        row = part.select(F.to_json(F.struct(*part.columns)).alias("j")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("j")), ","), F.lit("]")).alias("json")).select(F.lit(name).alias("name"), "json")
        out = row if out is None else out.unionByName(row)
    return out


def log_rows(events: DataFrame, run_id: str, details: Column) -> DataFrame:
    """Structured log rows of a run; details as JSON."""
    return events.select("ts", "level", "source", "action", F.to_json(details).alias("details_json"), F.lit(run_id).alias("run_id"))


def pending_files(spark: SparkSession, path: str, extensions: tuple[str, ...], sidecars: DataFrame | None = None) -> DataFrame:
    """(path, stem, size) of files with one of the extensions (none hidden) whose sidecar says that they are downloaded and no
    more, or that have none. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    name = F.regexp_extract("path", "([^/]+)$", 1)
    wanted = found.where(F.exists(F.array(*map(F.lit, extensions)), lambda e: F.endswith(F.lower(name), e)) & ~name.startswith("."))
    stems = wanted.select("path", F.regexp_extract(name, "^(.+?)(\\.[^.]*)?$", 1).alias("stem"), "size")
    if sidecars is None:
        return stems
    states = sidecars.select(F.regexp_extract(F.col("path"), "([^/]+)_metadata\\.json$", 1).alias("stem"), "status")
    return stems.join(states, "stem", "left").where(F.coalesce("status", F.lit("downloaded")) == "downloaded").drop("status")


def code_files(spark: SparkSession, path: str, pattern: str = "*.st") -> DataFrame:
    """(folder, name, text) of source files; bytes that are no UTF-8 become U+FFFD."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
