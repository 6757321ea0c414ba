"""Entity rows from texts: a dictionary extractor in place of the external one, filters, confidence and enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Confidence by how an extraction is aligned with its text, and what it is without alignment.
CONFIDENCE = {"exact": 0.95, "greater": 0.75, "fuzzy": 0.60}
UNALIGNED = 0.30
# Words too general to be an entity, by default.
GENERIC = (
    "companies", "company", "industry", "industries", "people",
    "professors", "professor", "colleges", "college", "universities",
    "university", "customers", "customer", "users", "user",
    "integrators", "integrator", "vendors", "vendor", "partners",
    "partner", "clients", "client", "others", "organizations",
    "organization", "team", "teams", "staff", "employees", "workers",
    "students", "student", "schools", "school", "government", "agencies",
    "things", "stuff", "data", "information", "content", "software",
    "hardware", "system", "systems", "solutions", "technology",
    "technologies", "product", "products", "service", "services",
    "platform", "platforms", "tool", "tools", "project", "projects",
)


def extract(docs: DataFrame, terms: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, start, end) of whole-word hits, by one regular expression over the text; places are code points."""
    pattern = "(?i)\\b(" + "|".join(terms) + ")\\b"
    hits = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1))
    parts = F.split(F.col(text_col), pattern, -1)
    found = docs.select(F.col(id_col).alias("doc_id"), hits.alias("h"), F.transform(parts, F.length).alias("p"))
    # a hit begins after all parts and hits before it
    places = F.aggregate(F.arrays_zip(F.col("h").alias("h"), F.slice("p", F.lit(1), F.size("h")).alias("p")), F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<term:string,start:int,end:int>>)").alias("out")), lambda a, x: F.struct((a["at"] + x["p"] + F.length(x["h"])).cast("int").alias("at"), F.concat(a["out"], F.array(F.struct(x["h"].alias("term"), (a["at"] + x["p"]).cast("int").alias("start"), (a["at"] + x["p"] + F.length(x["h"])).cast("int").alias("end")))).alias("out")))
    return found.where(F.size("h") > 0).select("doc_id", F.inline(places["out"]))


def reject_reason(entity: Column, kind: Column, generic: Sequence[str] = GENERIC) -> Column:
    """The first filter that an entity fails, null if none does."""
    return F.coalesce(
        F.when(F.length(F.trim(entity)) < 4, F.lit("short")),
        F.when(entity.rlike("^[\\d,.\\s%$+\\-]+[a-zA-Z]{0,2}$") & (kind != "performance_claim"), F.lit("bare number")),
        F.when(F.lower(F.trim(entity)).isin(*generic), F.lit("generic")),
    )


def confidence(alignment: Column) -> Column:
    out = F.lit(UNALIGNED)
    for name, value in CONFIDENCE.items():
        out = F.when(alignment == name, value).otherwise(out)
    return out


def enriched(kind: Column, industry: Column, entity: Column, context: Column) -> Column:
    """``type [industry] | entity — context``, without the brackets where there is no industry."""
    return F.concat(kind, F.when(F.coalesce(industry, F.lit("")) != "", F.concat(F.lit(" ["), industry, F.lit("]"))).otherwise(F.lit("")), F.lit(" | "), entity, F.lit(" — "), context)


def valid(rows: DataFrame, kinds: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that hold the rules of entity rows, and the rest."""
    ok = F.coalesce(F.length("entity").between(2, 500) & F.col("confidence").between(0, 1) & F.col("signal_type").isin(*kinds), F.lit(False))
    return rows.where(ok), rows.where(~ok)


def described(kind: Column, text: Column, detail: Column) -> Column:
    """``type: text``, and the detail behind a dash where there is one."""
    return F.concat(kind, F.lit(": "), text, F.when(F.coalesce(detail, F.lit("")) != "", F.concat(F.lit(" — "), detail)).otherwise(""))


def backfilled(rows: DataFrame, texts: DataFrame, window: Column) -> DataFrame:
    """Rows that lack their enriched text, with it: (id, outcome, enriched_text). ``rows``: id, source_content_id, entity,
    signal_type, industry, char_start, char_end, enriched_text; ``texts``: source_content_id, transcript. Without places,
    transcript or surroundings a row is skipped. ``window`` is over transcript, char_start and char_end."""
    lacking = rows.where(F.coalesce("enriched_text", F.lit("")) == "").drop("enriched_text")
    placed = lacking.join(texts, "source_content_id", "left")
    usable = F.col("char_start").isNotNull() & F.col("char_end").isNotNull() & (F.coalesce("transcript", F.lit("")) != "")
    context = placed.select("id", "signal_type", "industry", "entity", F.when(usable, window).alias("context"))
    done = F.coalesce(F.col("context"), F.lit("")) != ""
    text = enriched(F.col("signal_type"), F.col("industry"), F.col("entity"), F.col("context"))
    return context.select("id", F.when(done, "enriched").otherwise("skipped").alias("outcome"), F.when(done, text).alias("enriched_text"))
