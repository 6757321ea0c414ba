"""Queries of the quality gates, over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import gates as G
from lexforge.functions.language import learned
from lexforge.plans.tables import load
from lexforge.registry import query
from lexforge.sources.views import view, with_views

DUCK_WORDS = "list_filter(string_split_regex(lower(text), '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda w: w <> '')"
DUCK_LINES = "list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'), lambda x: regexp_replace(x, '^[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]+|[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]+$', '', 'g')), lambda x: x <> '')"
FURNITURE = "lambda x: regexp_full_match(x, '[\\d\\s.\\-–—/\\\\]+') OR (length(x) < 40 AND upper(x) = x AND regexp_matches(x, '\\p{Lu}') AND NOT regexp_matches(x, '\\p{Ll}')) OR regexp_full_match(lower(x), 'page\\s*\\d+|\\d+\\s*of\\s*\\d+')"
DIVERSITY = f"len(list_distinct({DUCK_WORDS})) / nullif(len({DUCK_WORDS}), 0)"
BOILERPLATE = f"len(list_filter({DUCK_LINES}, {FURNITURE})) / nullif(len({DUCK_LINES}), 0)"
DOMAIN = "(" + " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN 1 ELSE 0 END" for t in G.DOMAIN_WORDS) + f") / {len(G.DOMAIN_WORDS)}"
GARBAGE = f"length(regexp_replace(text, '[\\x20-\\x7f\\n\\r\\t{G.TYPOGRAPHIC}]+', '', 'g')) / nullif(length(text), 0)"
LATIN = "regexp_extract_all(lower(text), '[a-z]{2,}')"
PHRASE = "(" + " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{p}', ''))) / {len(p)}" for p in G.PHRASES) + f") * {G.PHRASE_CHARS} / nullif(length(text), 0)"


def docs(spark, sf):
    return load(spark, sf, "documents")


@query("j01_length", f"SELECT doc_id, length(text) < {G.MIN_CHARS} AS too_short, length(text) > {G.MAX_CHARS} AS very_long FROM documents")
def j01(spark, sf):
    return docs(spark, sf).select("doc_id", G.too_short(F.col("text")).alias("too_short"), G.very_long(F.col("text")).alias("very_long"))


@query("j02_token_diversity", f"SELECT doc_id, round({DIVERSITY}, 9) AS diversity FROM documents")
def j02(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(G.diversity(F.col("text")), 9).alias("diversity"))


@query("j03_boilerplate", f"SELECT doc_id, round({BOILERPLATE}, 9) AS boilerplate FROM documents")
def j03(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(G.boilerplate(F.col("text")), 9).alias("boilerplate"))


@query("j05_domain", f"SELECT doc_id, round({DOMAIN}, 9) AS domain FROM documents")
def j05(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(G.domain_share(F.col("text")), 9).alias("domain"))


STATISTICAL = f"CASE WHEN length(text) < {G.MIN_CHARS} THEN 'length' WHEN coalesce({DIVERSITY}, 0) < {G.MIN_DIVERSITY} THEN 'token_diversity' WHEN coalesce({BOILERPLATE}, 1) > {G.MAX_BOILERPLATE} THEN 'boilerplate' WHEN lang <> 'en' THEN 'language' WHEN {DOMAIN} < {G.MIN_DOMAIN} THEN 'domain_relevance' END"


@query("j06_verdict", f"SELECT doc_id, coalesce({STATISTICAL}, 'pass') AS failed_gate FROM documents")
def j06(spark, sf):
    return docs(spark, sf).select("doc_id", F.coalesce(G.statistical(F.col("text"), F.col("lang")), F.lit("pass")).alias("failed_gate"))


def told(spark, sf):
    """Profiles from four fifths of the documents, by their numbers."""
    return learned(docs(spark, sf).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))


@query("j04_language")
def j04(spark, sf):
    """The language that each document's text has, and whether it was held out of the profiles."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs(spark, sf).select("doc_id", held.alias("held_out"), "lang", told(spark, sf).of(F.col("text")).alias("found"))


@query("j04_verdict")
def j04_verdict(spark, sf):
    """The gates with the language of the text itself."""
    rows = docs(spark, sf).withColumn("own", told(spark, sf).of(F.col("text")))
    return rows.select("doc_id", F.coalesce(G.statistical(F.col("text"), F.coalesce("own", F.lit(""))), F.lit("pass")).alias("failed_gate"))


@query("j11_garbage", f"SELECT doc_id, round({GARBAGE}, 9) AS garbage FROM documents")
def j11(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(G.garbage(F.col("text")), 9).alias("garbage"))


@query("j12_word_diversity", f"SELECT doc_id, round(len(list_distinct({LATIN})) / nullif(len({LATIN}), 0), 9) AS diversity FROM documents")
def j12(spark, sf):
    latin = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))
    return docs(spark, sf).select("doc_id", F.round(F.size(F.array_distinct(latin)) / F.nullif(F.size(latin), F.lit(0)), 9).alias("diversity"))


@query("j13_phrases", f"SELECT doc_id, round({PHRASE}, 9) AS share FROM documents")
def j13(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(G.phrase_share(F.col("text")), 9).alias("share"))


BARE = "regexp_replace(text, '^[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]+|[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]+$', '', 'g')"
NOISY = " ".join(f"WHEN regexp_matches(substring({{t}}, 1, {G.HEAD}), '{p}') THEN 'noise {i}'" for i, p in enumerate(G.NOISE))


def rules(column: str) -> str:
    """The first rule that a text column fails."""
    t = BARE.replace("text", column)
    inner = lambda sql: sql.replace("text", t)
    return (
        f"CASE WHEN {t} = '' THEN 'empty' WHEN length({t}) < {G.MIN_STRIPPED} THEN 'too_short' {NOISY.replace('{t}', t)}"
        f" WHEN {inner(GARBAGE)} > {G.MAX_GARBAGE} THEN 'garbage'"
        f" WHEN len({inner(LATIN)}) >= {G.MIN_WORDS} AND len(list_distinct({inner(LATIN)})) / len({inner(LATIN)}) < {G.MIN_WORD_DIVERSITY} THEN 'low_diversity'"
        f" WHEN {inner(PHRASE)} > {G.MAX_PHRASES} THEN 'boilerplate' END"
    )


RULES = rules("text")


@query("j14_rule_gate", f"SELECT doc_id, coalesce({RULES}, 'pass') AS failed_rule FROM documents")
def j14(spark, sf):
    return docs(spark, sf).select("doc_id", F.coalesce(G.rule_based(F.col("text")), F.lit("pass")).alias("failed_rule"))


SCOPES = {"unscreened": "screening_status = 'pending'", "non_rejected": "screening_status NOT IN ('rejected', 'dq_rejected')", "all": "true"}
JUDGED = with_views("content", then=f"SELECT id, screening_status, coalesce(screening_reason, '') AS screening_reason, {rules('transcript')} AS failed FROM content")


@query(
    "j15_retroactive_gate",
    f"WITH j AS ({JUDGED}) " + " UNION ALL ".join(f"SELECT '{name}' AS scope, id, CASE WHEN failed IS NULL THEN screening_status ELSE 'dq_rejected' END AS screening_status, CASE WHEN failed IS NULL THEN screening_reason ELSE concat('[quality_gate] ', failed) END AS screening_reason FROM j WHERE {scope}" for name, scope in SCOPES.items()),
)
def j15(spark, sf):
    """Rows of each of the three scopes, judged again: what passes is left as it is, what fails is rejected and told why."""
    content = view(spark, sf, "content")
    out = None
    for name, scope in SCOPES.items():
        again = G.regated(content.where(scope), F.col("transcript"))
        row = again.select(F.lit(name).alias("scope"), "id", "screening_status", F.coalesce("screening_reason", F.lit("")).alias("screening_reason"))
        out = row if out is None else out.unionByName(row)
    return out


@query("j18_decisions", with_views("content", then="SELECT c.id, CASE WHEN b.quality = 1 THEN 'approved' WHEN b.quality = 0 THEN 'rejected' ELSE c.screening_status END AS screening_status, CASE WHEN b.quality = 0 THEN 'not_applicable' ELSE c.vectorization_status END AS vectorization_status, coalesce(b.quality = 0, false) AS marked_for_deletion FROM content c LEFT JOIN labels b ON c.id = b.doc_id"))
def j18(spark, sf):
    """The decision comes from a column; here the labels stand for the external judge (J17)."""
    labels = load(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "approve").otherwise("reject").alias("decision"))
    joined = view(spark, sf, "content").join(labels, "id", "left")
    return G.decided(joined, F.col("decision"), F.lit(1.0)).select("id", "screening_status", "vectorization_status", "marked_for_deletion")
