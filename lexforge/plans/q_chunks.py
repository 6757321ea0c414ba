"""Queries of chunking and of entity extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import boundaries as S
from lexforge.functions import sql
from lexforge.operators import chunking as L
from lexforge.operators import extraction as M
from lexforge.plans.fragments import FOLD, SENTENCES
from lexforge.plans.tables import load
from lexforge.registry import query
from lexforge.sources.views import view, with_views

c = F.col


def docs(spark, sf):
    return load(spark, sf, "documents")


def chunked(spark, sf, overlap=1):
    s = docs(spark, sf).select("doc_id", "text", L.sentences(c("text")).alias("s"))
    return s.select("doc_id", "text", "s", L.pack(c("s"), overlap=overlap).alias("p"))


@query("l01_sentences", f"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS ord, md5(unnest(s)) AS digest FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def l01(spark, sf):
    s = docs(spark, sf).select("doc_id", F.posexplode(L.sentences(c("text"))).alias("ord", "sentence"))
    return s.select("doc_id", "ord", F.md5(c("sentence").cast("binary")).alias("digest"))


@query(
    "l01_abbreviations",
    r"""WITH t AS (SELECT t FROM (SELECT unnest(string_split_regex(lower(text), '\s+')) AS t FROM documents) WHERE t <> ''),
    k AS (SELECT CASE WHEN regexp_matches(t, '^\p{L}[\p{L}.]*\.$') THEN regexp_replace(t, '\.$', '') WHEN regexp_matches(t, '^\p{L}([\p{L}.]*\p{L})?[,;:]?$') THEN regexp_replace(t, '[,;:]$', '') END AS type, regexp_matches(t, '^\p{L}[\p{L}.]*\.$') AS dot FROM t),
    c AS (SELECT type, count(*)::DOUBLE AS n, count(CASE WHEN dot THEN 1 END)::DOUBLE AS d FROM k GROUP BY 1), a AS (SELECT sum(d) / sum(n) AS p FROM c),
    s AS (SELECT type, n, d, -2 * ((d * ln(p) + (n - d) * ln(1 - p)) - (d * ln(0.99) + (n - d) * ln(1 - 0.99))) AS ratio, (length(type) - length(replace(type, '.', '')))::DOUBLE AS inner_ FROM c, a WHERE type IS NOT NULL AND d > 0)
    SELECT type, CAST(d AS BIGINT) AS dotted, CAST(n - d AS BIGINT) AS plain, CASE WHEN abs(score) < 1e-6 THEN 0.0::DOUBLE ELSE score END AS score FROM (SELECT type, d, n, round(ratio * exp(-(length(type) - inner_ + 1)) * (inner_ + 1) * pow(length(type) - inner_ + 1, d - n), 6) AS score FROM s)""",
)
def l01_abbreviations(spark, sf):
    """How much each type before a period looks like an abbreviation."""
    return S.scored(docs(spark, sf)).withColumn("score", F.when(F.abs(F.round("score", 6)) < 1e-6, 0.0).otherwise(F.round("score", 6)))


@query("l01_learned")
def l01_learned(spark, sf):
    """Sentences that do not end behind the abbreviations of these documents."""
    known = S.abbreviations(docs(spark, sf))
    s = docs(spark, sf).select("doc_id", F.posexplode(S.split(c("text"), known)).alias("ord", "sentence"))
    return s.select("doc_id", "ord", F.md5(c("sentence").cast("binary")).alias("digest"))




@query("l02_chunks", FOLD.format(sentences=SENTENCES) + " SELECT doc_id, b AS first_sentence, e AS past_sentence, md5(array_to_string(s[b + 1:e], ' ')) AS digest FROM (SELECT doc_id, cb AS b, ce AS e FROM r WHERE cb >= 0 UNION ALL SELECT r.doc_id, r.b, r.i FROM r JOIN s USING (doc_id) WHERE r.i = len(s.s) AND len(s.s) > 0) JOIN s USING (doc_id)")
def l02(spark, sf):
    """Every chunk of every document, by its sentences and the digest of its text."""
    p = chunked(spark, sf).select("doc_id", F.arrays_zip(L.chunk_texts(c("s"), c("p")).alias("t"), c("p").alias("p")).alias("z")).select("doc_id", F.inline("z"))
    return p.select("doc_id", c("p.b").alias("first_sentence"), c("p.e").alias("past_sentence"), F.md5(c("t").cast("binary")).alias("digest"))


@query("t01_chunks_in_sql", FOLD.format(sentences=SENTENCES) + " SELECT doc_id, b AS first_sentence, e AS past_sentence, md5(array_to_string(s[b + 1:e], ' ')) AS digest FROM (SELECT doc_id, cb AS b, ce AS e FROM r WHERE cb >= 0 UNION ALL SELECT r.doc_id, r.b, r.i FROM r JOIN s USING (doc_id) WHERE r.i = len(s.s) AND len(s.s) > 0) JOIN s USING (doc_id)")
def t01(spark, sf):
    """The same chunks by a table function in a SQL text."""
    sql.register(spark)
    return spark.sql(f"SELECT d.doc_id, c.first_sentence, c.past_sentence, md5(CAST(c.chunk AS BINARY)) AS digest FROM {{docs}} d, LATERAL {sql.CHUNKS}(d.text, 600, 1) c", docs=docs(spark, sf).select("doc_id", "text"))


FOLD0 = """WITH RECURSIVE s AS (SELECT doc_id, text, s, list_transform(s, lambda x: length(x)) AS n FROM (SELECT doc_id, text, {sentences} AS s FROM documents)),
r(doc_id, i, b, size, cb, ce) AS (SELECT doc_id, 0, 0, 0, -1, -1 FROM s UNION ALL
SELECT r.doc_id, r.i + 1, CASE WHEN r.size + s.n[r.i + 1] > 600 AND r.i > r.b THEN r.i ELSE r.b END, CASE WHEN r.size + s.n[r.i + 1] > 600 AND r.i > r.b THEN s.n[r.i + 1] ELSE r.size + s.n[r.i + 1] END,
CASE WHEN r.size + s.n[r.i + 1] > 600 AND r.i > r.b THEN r.b ELSE -1 END, r.i FROM r JOIN s USING (doc_id) WHERE r.i < len(s.s)),
p AS (SELECT doc_id, cb AS b, ce AS e FROM r WHERE cb >= 0 UNION ALL SELECT r.doc_id, r.b, r.i FROM r JOIN s USING (doc_id) WHERE r.i = len(s.s) AND len(s.s) > 0)"""


@query(
    "l03_offsets",
    FOLD0.format(sentences=SENTENCES) + ", t AS (SELECT doc_id, b, instr(text, s[b + 1]) - 1 AS start_char, length(array_to_string(s[b + 1:e], ' ')) AS char_count FROM p JOIN s USING (doc_id)) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS INT) AS ord, start_char, start_char + char_count AS end_char, char_count FROM t",
)
def l03(spark, sf):
    """Chunks without overlap, with where their first sentence first stands in the text and where they end from there."""
    p = chunked(spark, sf, 0).select("doc_id", "text", "s", F.posexplode("p").alias("ord", "p"))
    start = F.expr("locate(s[p.b], text)") - 1
    body = F.expr("array_join(slice(s, p.b + 1, p.e - p.b), ' ')")
    return p.select("doc_id", "ord", start.alias("start_char"), (start + F.length(body)).alias("end_char"), F.length(body).alias("char_count"))


COUNTS = "SELECT doc_id, count(*) AS k FROM (SELECT doc_id FROM r WHERE cb >= 0 UNION ALL SELECT r.doc_id FROM r JOIN s USING (doc_id) WHERE r.i = len(s.s) AND len(s.s) > 0) GROUP BY 1"


@query(
    "l04_rechunk_delta",
    f"""WITH a AS ({FOLD.format(sentences=SENTENCES)} {COUNTS}), b AS ({FOLD0.format(sentences=SENTENCES)} {COUNTS}), d AS (SELECT doc_id, coalesce(a.k, 0) AS old, coalesce(b.k, 0) AS new FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) WHERE length(text) > 200)
    SELECT count(*) AS documents, CAST(sum(old) AS BIGINT) AS old_chunks, CAST(sum(new) AS BIGINT) AS new_chunks, CAST(sum(new - old) AS BIGINT) AS delta FROM d""",
)
def l04(spark, sf):
    """Chunk counts with and without overlap of documents over 200 characters."""
    s = docs(spark, sf).where(F.length("text") > 200).select(L.sentences(c("text")).alias("s"))
    n = s.select(F.size(L.pack(c("s"), overlap=1)).alias("old"), F.size(L.pack(c("s"), overlap=0)).alias("new"))
    return n.agg(F.count(F.lit(1)).alias("documents"), F.sum("old").alias("old_chunks"), F.sum("new").alias("new_chunks"), F.sum(c("new") - c("old")).alias("delta"))


@query("l05_word_segments")
def l05(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(L.word_segments(c("text"))).alias("ord", "words"))


@query("l06_slices", "SELECT doc_id, CAST(i AS INT) AS ord, md5(substring(text, CAST(i AS BIGINT) * 8000 + 1, 8000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 7999) // 8000)) AS i FROM documents)")
def l06(spark, sf):
    p = docs(spark, sf).select("doc_id", F.posexplode(L.slices(c("text"))).alias("ord", "t"))
    return p.select("doc_id", "ord", F.md5(c("t").cast("binary")).alias("digest"))


@query("l07_vector_chunks", FOLD.format(sentences=SENTENCES) + " SELECT doc_id, count(*) AS n FROM (SELECT doc_id, length(array_to_string(s[b + 1:e], ' ')) AS k FROM (SELECT doc_id, cb AS b, ce AS e FROM r WHERE cb >= 0 UNION ALL SELECT r.doc_id, r.b, r.i FROM r JOIN s USING (doc_id) WHERE r.i = len(s.s) AND len(s.s) > 0) JOIN s USING (doc_id)) WHERE k BETWEEN 50 AND 1500 GROUP BY 1")
def l07(spark, sf):
    p = chunked(spark, sf).select("doc_id", F.explode(L.chunk_texts(c("s"), c("p"))).alias("t"))
    return p.where(L.worth_a_vector(c("t"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("l09_context", "SELECT doc_id, trim(CASE WHEN hi < n AND instr(reverse(head), ' ') BETWEEN 1 AND 30 THEN substring(head, 1, length(head) - instr(reverse(head), ' ')) ELSE head END) AS context FROM (SELECT *, CASE WHEN lo > 0 AND instr(piece, ' ') BETWEEN 1 AND 30 THEN substring(piece, instr(piece, ' ') + 1) ELSE piece END AS head FROM (SELECT doc_id, n, lo, hi, substring(text, lo + 1, hi - lo) AS piece FROM (SELECT doc_id, text, length(text) AS n, greatest(400 - 250, 0) AS lo, least(410 + 250, length(text)) AS hi FROM documents WHERE length(text) >= 410)))")
def l09(spark, sf):
    """Around the characters 400 to 410."""
    long = docs(spark, sf).where(F.length("text") >= 410)
    return long.select("doc_id", L.context_window(c("text"), F.lit(400), F.lit(410)).alias("context"))


@query("l10_excerpt", "SELECT doc_id, md5(substring(text, 1, 2000)) AS digest FROM documents")
def l10(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(F.substring("text", 1, 2000).cast("binary")).alias("digest"))


@query("x11_segment_ids", with_views("content", then="SELECT concat(CAST(id AS STRING), '_seg_', CAST(i AS STRING)) AS segment_id FROM (SELECT id, unnest(range(0, (length(transcript) + 7999) // 8000)) AS i FROM content WHERE screening_status = 'approved')"))
def x11(spark, sf):
    approved = view(spark, sf, "content").where("screening_status = 'approved'")
    return approved.select("id", F.posexplode(L.slices(c("transcript"))).alias("i", "t")).select(F.format_string("%d_seg_%d", "id", "i").alias("segment_id"))


TERMS = ("apache", "license", "email", "idiot", "stupid", "clown")


@query("m01_extract", "SELECT doc_id, lower(term) AS term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b(" + "|".join(TERMS) + ")\\b', 1)) AS term FROM documents) GROUP BY ALL")
def m01(spark, sf):
    return M.extract(docs(spark, sf), TERMS).groupBy("doc_id", F.lower("term").alias("term")).agg(F.count(F.lit(1)).alias("n"))


@query("m01_positions")
def m01_positions(spark, sf):
    return M.extract(docs(spark, sf), TERMS)


@query("m02_filters", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(trim(p_name)) < 4 THEN 'short' WHEN regexp_full_match(p_name, '[\\d,.\\s%$+\\-]+[a-zA-Z]{0,2}') AND p_type <> 'performance_claim' THEN 'bare number' WHEN lower(trim(p_name)) IN (" + ", ".join(f"'{g}'" for g in M.GENERIC) + ") THEN 'generic' ELSE 'kept' END AS reason FROM (SELECT p_name, p_type FROM part UNION ALL SELECT substring(p_name, 1, 3), p_type FROM part UNION ALL SELECT CAST(p_size AS STRING) || '000 kW', p_type FROM part)) GROUP BY 1")
def m02(spark, sf):
    part = load(spark, sf, "part")
    names = part.select("p_name", "p_type").unionByName(part.select(F.substring("p_name", 1, 3).alias("p_name"), "p_type")).unionByName(part.select(F.concat(c("p_size").cast("string"), F.lit("000 kW")).alias("p_name"), "p_type"))
    return names.groupBy(F.coalesce(M.reject_reason(c("p_name"), c("p_type")), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("m03_confidence", "SELECT l_orderkey AS id, l_linenumber AS line, CASE l_returnflag WHEN 'A' THEN 0.95::DOUBLE WHEN 'N' THEN 0.75::DOUBLE ELSE 0.30::DOUBLE END AS confidence FROM lineitem")
def m03(spark, sf):
    flag = c("l_returnflag")
    alignment = F.when(flag == "A", "exact").when(flag == "N", "greater")
    return load(spark, sf, "lineitem").select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), M.confidence(alignment).alias("confidence"))


@query("m04_enriched", with_views("signals", then="SELECT id, concat(signal_type, CASE WHEN coalesce(industry, '') <> '' THEN concat(' [', industry, ']') ELSE '' END, ' | ', entity, ' — ', line_status) AS text FROM signals"))
def m04(spark, sf):
    return view(spark, sf, "signals").select("id", M.enriched(c("signal_type"), c("industry"), c("entity"), c("line_status")).alias("text"))


@query("m07_valid", with_views("signals", then="SELECT count(*) AS valid, (SELECT count(*) FROM signals) - count(*) AS invalid FROM signals WHERE length(entity) BETWEEN 2 AND 500 AND confidence BETWEEN 0 AND 1 AND signal_type IN ('STANDARD', 'SMALL', 'MEDIUM')"))
def m07(spark, sf):
    ok, bad = M.valid(view(spark, sf, "signals"), ("STANDARD", "SMALL", "MEDIUM"))
    return ok.agg(F.count(F.lit(1)).alias("valid")).join(bad.agg(F.count(F.lit(1)).alias("invalid")), how="cross")
