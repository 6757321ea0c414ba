"""Queries of keyed updates, enrichment, look-ups, planners and ingestion records."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexforge.functions import parsing as S
from lexforge.functions import web as W
from lexforge.operators import aggregates as A
from lexforge.operators import chunking as L
from lexforge.operators import corpus_map as P
from lexforge.operators import dedup as D
from lexforge.operators import discovery as R
from lexforge.operators import extraction as M
from lexforge.operators import merging as B
from lexforge.operators import retrieval as N
from lexforge.plans.q_dedup import CLUSTERS, prints
from lexforge.plans.q_retrieval import BM25, NN, RELEVANT, asked, docs, neighbours
from lexforge.plans.tables import checkpoint_dir, load, materialize
from lexforge.registry import query
from lexforge.sources import files
from lexforge.sources.views import view, with_views

c = F.col
VIEW = {n: with_views(n, then="SELECT 1").removesuffix("SELECT 1").rstrip() for n in ("content", "signals", "system_logs")}


# B: inserts, upserts and updates

@query(
    "b01_insert",
    "WITH s AS (SELECT max(doc_id) AS top FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT count(*) AS ids FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, length(text) AS chars, top + 1 AS first_id, top + ids AS last_id, ids FROM documents, s, n WHERE doc_id % 3 = 0",
)
def b01_insert(spark, sf):
    """Documents whose path is not stored get the next ids, without gaps; NUL characters are dropped."""
    path = F.lpad(c("doc_id").cast("string"), 12, "0").alias("file_path")
    stored = docs(spark, sf).where("doc_id % 3 <> 0").select(c("doc_id").alias("id"), path)
    incoming = docs(spark, sf).select(path, "doc_id", F.concat("text", F.lit("\u0000")).alias("transcript"))
    new = B.inserted(stored, incoming, "file_path", texts=["transcript"])
    new = materialize(new)
    ids = new.agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.countDistinct("id").alias("ids"))
    return new.select("doc_id", F.length("transcript").alias("chars")).crossJoin(F.broadcast(ids))


@query(
    "b03_upsert_signals",
    f"""{VIEW["signals"]}, k AS (SELECT id, min(entity) AS entity, min(extracted_at) AS extracted_at FROM signals GROUP BY 1),
    s AS (SELECT * FROM k WHERE id % 10 <> 1), n AS (SELECT * FROM k WHERE id % 2 = 1)
    SELECT coalesce(s.id, n.id) AS id, CASE WHEN n.id IS NULL THEN s.entity ELSE upper(n.entity) END AS entity,
    CASE WHEN s.id IS NULL THEN '-' ELSE 'v' END AS vectorized, CASE WHEN s.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS action
    FROM s FULL OUTER JOIN n ON s.id = n.id""",
)
def b03(spark, sf):
    """By id: all columns but the extraction's own and whether it is vectorised are taken over; nothing is skipped."""
    rows = view(spark, sf, "signals").groupBy("id").agg(F.min("entity").alias("entity"), F.min("extracted_at").alias("extracted_at"))
    stored = rows.where("id % 10 <> 1").withColumn("vectorized", F.lit("v"))
    incoming = rows.where("id % 2 = 1").select("id", F.upper("entity").alias("entity"), "extracted_at")
    return B.merge_by_key(stored, incoming, "id", keep=["extracted_at", "vectorized"]).select("id", "entity", F.coalesce("vectorized", F.lit("-")).alias("vectorized"), "action")


@query(
    "b04_upsert_logs",
    f"{VIEW['system_logs']} SELECT id, CASE WHEN id % 2 = 0 THEN 'NEW' ELSE level END AS level, CASE WHEN id % 3 = 0 THEN 'inserted' WHEN id % 2 = 0 THEN 'updated' ELSE 'kept' END AS action FROM system_logs WHERE id % 3 <> 0 OR id % 2 = 0",
)
def b04(spark, sf):
    logs = view(spark, sf, "system_logs").select("id", "level", "source")
    incoming = logs.where("id % 2 = 0").withColumn("level", F.lit("NEW"))
    return B.merge_by_key(logs.where("id % 3 <> 0"), incoming, "id").select("id", "level", "action")


@query(
    "b06_update",
    f"{VIEW['content']} SELECT id, CASE WHEN id % 4 = 0 THEN 'a b' ELSE title END AS title, created_at, CASE WHEN id % 2 = 0 THEN '2024-05-01' ELSE '-' END AS updated_at FROM content",
)
def b06(spark, sf):
    """Changes of titles by id; the time of creation stays whatever comes."""
    stored = view(spark, sf, "content").select("id", "title", "created_at", F.lit("-").alias("updated_at"))
    changes = stored.where("id % 2 = 0").select("id", F.when(c("id") % 4 == 0, F.lit("a\u0000 b")).alias("title"), F.lit(None).alias("created_at"))
    return B.update_by_key(stored, changes, "id", F.lit("2024-05-01"))


KINDS = ("ECONOMY", "STANDARD", "SMALL")


@query(
    "b07_insert_signals",
    f"{VIEW['signals']}, d AS (SELECT id, min(entity) AS entity FROM signals WHERE signal_type IN {KINDS} AND confidence BETWEEN 0 AND 1 AND length(entity) BETWEEN 2 AND 500 GROUP BY 1) SELECT entity, count(*) AS n, (SELECT count(*) FROM d) AS last_id FROM d GROUP BY 1",
)
def b07(spark, sf):
    """Valid rows get ids after the largest; the table is empty before."""
    valid, _ = M.valid(view(spark, sf, "signals"), KINDS)
    rows = valid.groupBy(c("id").alias("old_id")).agg(F.min("entity").alias("entity"))
    numbered = materialize(B.numbered(rows, 0, "old_id"))
    last = numbered.agg(F.max("id").alias("last_id"))
    return numbered.groupBy("entity").agg(F.countDistinct("id").alias("n")).crossJoin(F.broadcast(last))


@query("b08_cache_texts", "SELECT query, md5(substring(input, 1, 500)) AS input FROM (SELECT substring(source || ' ' || lang || ' ' || repeat(source, 60), 1, 200) AS query, text AS input, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def b08_texts(spark, sf):
    """Cached texts are cut to what the cache holds; the last of a key stays."""
    key = F.concat_ws(" ", "source", "lang", F.repeat("source", 60))
    rows = docs(spark, sf).select(F.substring(key, 1, 200).alias("query"), F.substring("text", 1, 500).alias("input"), "doc_id")
    return B.last_writer(rows, ["query"], c("doc_id")).select("query", F.md5(c("input").cast("binary")).alias("input"))


# C, E: a prefix with a wildcard in it, cache statistics

@query("c07_gate_rejects", with_views("content", then="SELECT id FROM content WHERE screening_reason LIKE '[quality_gate]%'"))
def c07(spark, sf):
    return view(spark, sf, "content").where(c("screening_reason").like("[quality_gate]%")).select("id")


@query("e30_cache_stats", "SELECT event_type, count(*) AS entries, CAST(sum(user_id) AS BIGINT) AS results FROM events GROUP BY 1")
def e30(spark, sf):
    return R.cache_stats(load(spark, sf, "events"), "event_type", "user_id")


# A, I: functions of strings

@query("a07_general_types", with_views("content", then="SELECT id, CASE content_type WHEN 'audio' THEN 'audio' WHEN 'html' THEN 'html' ELSE 'text' END AS kind FROM content"))
def a07(spark, sf):
    return view(spark, sf, "content").select("id", W.general_type(c("content_type")).alias("kind"))


@query("a10_page_text", "SELECT doc_id, md5(regexp_replace(replace(text, '. ', '.' || repeat(chr(10), CAST(doc_id % 6 AS INT))), '\\n{4,}', repeat(chr(10), 3), 'g')) AS digest FROM documents")
def a10(spark, sf):
    """Sentences parted by form feeds, up to five in a row."""
    paged = F.replace(c("text"), F.lit(". "), F.concat(F.lit("."), F.repeat(F.lit("\f"), (c("doc_id") % 6).cast("int"))))
    return docs(spark, sf).select("doc_id", F.md5(S.page_text(paged).cast("binary")).alias("digest"))


@query(
    "a21_best_urls",
    "SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '#cached' WHEN 1 THEN url || '#open' WHEN 2 THEN url || '#first' WHEN 3 THEN url || '#second' ELSE '' END AS pdf, CASE WHEN page_id % 2 = 0 THEN 'doi:' || CAST(page_id AS STRING) WHEN page_id % 5 = 2 THEN url ELSE 'id' || CAST(page_id AS STRING) END AS landing FROM pages",
)
def a21(spark, sf):
    """Works with a link in each of the places."""
    at, url = c("page_id") % 5, c("url")
    link = lambda n, tag: F.when(at == n, F.concat(url, F.lit(tag)))
    work = F.struct(
        F.concat(F.lit("id"), c("page_id").cast("string")).alias("id"),
        F.when(c("page_id") % 2 == 0, F.concat(F.lit("doi:"), c("page_id").cast("string"))).alias("doi"),
        F.struct((at == 0).alias("pdf")).alias("has_content"),
        F.concat(url, F.lit("#cached")).alias("content_url"),
        F.struct(link(1, "#open").alias("pdf_url")).alias("best_oa_location"),
        F.struct(link(2, "#first").alias("pdf_url"), F.when(at == 2, url).alias("landing_page_url")).alias("primary_location"),
        F.array(F.struct(F.lit("").alias("pdf_url")), F.struct(link(3, "#second").alias("pdf_url"))).alias("locations"),
        F.struct(url.alias("oa_url")).alias("open_access"),
    )
    return load(spark, sf, "pages").select("page_id", W.best_pdf_url(work).alias("pdf"), W.best_url(work).alias("landing"))


@query("i06_arxiv", "SELECT page_id, contains(regexp_extract(u, '^[a-z]+://([^/?#]+)', 1), 'arxiv.org') AS arxiv, replace(u, '/abs/', '/pdf/') AS pdf FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http://export.arxiv.org/abs/' || CAST(page_id AS STRING) ELSE url END AS u FROM pages)")
def i06(spark, sf):
    url = F.when(c("page_id") % 2 == 0, F.concat(F.lit("http://export.arxiv.org/abs/"), c("page_id").cast("string"))).otherwise(c("url"))
    return load(spark, sf, "pages").select("page_id", W.is_arxiv(url).alias("arxiv"), W.arxiv_pdf(url).alias("pdf"))


@query("i15_recovered_json", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def i15(spark, sf):
    """The events' JSON as a model may wrap it: bare, fenced, in prose, before another brace; and cut off."""
    p, at = c("props"), c("event_id") % 5
    raw = F.when(at == 0, p).when(at == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(at == 2, F.concat(F.lit("So: "), p, F.lit(" done.")))
    raw = raw.when(at == 3, F.concat(F.lit("a "), p, F.lit(" and {more}"))).otherwise(F.expr("substring(props, 1, length(props) - 1)"))
    found = F.try_variant_get(S.recovered_json(raw), "$.k", "bigint")
    return load(spark, sf, "events").select("event_id", F.coalesce(found, F.lit(-1)).alias("k"))


@query(
    "i16_parsed_list",
    "SELECT user_id, i AS place, CASE WHEN i <= n AND user_id % 4 <> 3 THEN k[CAST(i AS INT)] ELSE -1 END AS k FROM (SELECT coalesce(user_id, -1) AS user_id, least(count(*), 3) AS n, list(CAST(json_extract_string(props, '$.k') AS BIGINT) ORDER BY event_id) AS k FROM events GROUP BY 1), (SELECT unnest([1, 2, 3, 4]) AS i)",
)
def i16(spark, sf):
    """Answers of up to three items where four are expected; some fenced, some no JSON."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("event_id", "props"))), 1, 3)
    answers = load(spark, sf, "events").groupBy(F.coalesce("user_id", F.lit(-1)).alias("user_id")).agg(first.alias("p"))
    body = F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: x["props"]), ", "), F.lit("]"))
    raw = F.when(c("user_id") % 4 == 3, F.rtrim(body, F.lit("]"))).when(c("user_id") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    items = S.parsed_list(raw, F.lit(4), "struct<k:bigint>")
    flat = answers.select("user_id", F.posexplode(items).alias("place", "x"))
    return flat.select("user_id", (c("place") + 1).alias("place"), F.coalesce("x.k", F.lit(-1)).alias("k"))


def _has(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


METRICS = ", ".join(f"CASE WHEN {_has(ws)} THEN '{m}' END" for m, ws in S.METRIC_WORDS.items())
GROUPS = " ".join(f"WHEN {_has(ws)} THEN '{g}'" for g, ws in S.GROUP_WORDS.items())
WORDS = ("compare production", "daily grid usage", "chart of soc by anomaly", "show it")
QUESTION = "text || ' ' || CASE turn % 4 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " END"


@query(
    "i21_chart_intent",
    f"SELECT conv_id, turn, CASE WHEN asks THEN CASE WHEN ms <> '' THEN ms ELSE 'production_power_w,consumption_power_w' END END AS metrics, CASE WHEN asks THEN g END AS grouped FROM (SELECT conv_id, turn, {_has(S.CHART_WORDS)} AS asks, concat_ws(',', {METRICS}) AS ms, CASE {GROUPS} ELSE 'site' END AS g FROM (SELECT conv_id, turn, lower({QUESTION}) AS q FROM conversations))",
)
def i21(spark, sf):
    question = F.concat_ws(" ", "text", F.element_at(F.array(*map(F.lit, WORDS)), (c("turn") % 4 + 1).cast("int")))
    metrics, group = S.chart_intent(question)
    return load(spark, sf, "conversations").select("conv_id", "turn", F.array_join(metrics, ",").alias("metrics"), group.alias("grouped"))


@query("l08_truncated", "SELECT doc_id, md5(substring(text, 1, 2048)) AS digest FROM documents")
def l08(spark, sf):
    """For a model of 512 tokens."""
    return docs(spark, sf).select("doc_id", F.md5(S.truncated(c("text"), 512).cast("binary")).alias("digest"))


# K: losers, exact copies, downloads

@query(
    "k06_losers",
    CLUSTERS
    + VIEW["content"].replace("WITH ", ", ", 1)
    + """, m AS (SELECT c.id, cl.cluster, c.signal_processed, c.pub_date, c.content_type AS source_type, length(c.transcript) AS size FROM content c JOIN cl ON c.id = cl.id),
    q AS (SELECT cluster, count(*) AS n, list_sort(list(size))[count(*) // 2 + 1] AS median FROM m GROUP BY 1 HAVING count(*) > 1),
    s AS (SELECT m.id, m.cluster, CASE WHEN coalesce(signal_processed, false) THEN 3 ELSE 0 END + CASE WHEN coalesce(pub_date, '') <> '' THEN 2 ELSE 0 END + CASE WHEN source_type IN ('pdf', 'html') THEN 1 ELSE 0 END + CASE WHEN size >= median THEN 1 ELSE 0 END AS score FROM m JOIN q USING (cluster)),
    w AS (SELECT id, first_value(id) OVER (PARTITION BY cluster ORDER BY score DESC, id) AS winner FROM s)
    SELECT c.id, coalesce(w.id <> w.winner, false) AS marked_for_deletion, CASE WHEN w.id <> w.winner THEN 'dq_rejected' ELSE c.screening_status END AS screening_status,
    CASE WHEN w.id <> w.winner THEN concat('near_duplicate: simhash_dist≤5, kept id=', CAST(w.winner AS STRING)) ELSE coalesce(c.screening_reason, '') END AS screening_reason, coalesce(c.do_not_vectorize, false) AS do_not_vectorize FROM content c LEFT JOIN w ON c.id = w.id""",
)
def k06(spark, sf):
    content = view(spark, sf, "content")
    own = content.select("id", "signal_processed", "pub_date", c("content_type").alias("source_type"), F.length("transcript").alias("size"))
    judged = materialize(D.survivors(materialize(own.join(D.clusters(prints(spark, sf), 5), "id"))))
    state = content.select("id", "screening_status", F.coalesce("screening_reason", F.lit("")).alias("screening_reason"), F.coalesce("do_not_vectorize", F.lit(False)).alias("do_not_vectorize"))
    return D.marked_losers(state, judged, 5).select("id", "marked_for_deletion", "screening_status", "screening_reason", "do_not_vectorize")


@query("k08_hash_cleanup", with_views("content", then="SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY content_hash ORDER BY created_at DESC, id DESC) AS r FROM content) WHERE r > 1"))
def k08(spark, sf):
    return D.not_newest(view(spark, sf, "content").select("id", "content_hash", "created_at"), "content_hash", "created_at")


@query("k15_downloads", "SELECT page_id FROM pages WHERE page_id % 2 = 1 AND md5(url) NOT IN (SELECT md5(url) FROM pages WHERE page_id % 2 = 0) AND page_id % 5 <> 0")
def k15(spark, sf):
    """Candidates whose path is neither stored nor on disk."""
    paths = load(spark, sf, "pages").select("page_id", F.md5(c("url").cast("binary")).alias("path"), F.concat(F.lit("f"), c("page_id").cast("string")).alias("file"))
    stored = paths.where("page_id % 2 = 0").select("path")
    on_disk = paths.where("page_id % 5 = 0").select("file")
    return paths.where("page_id % 2 = 1").join(stored, "path", "left_anti").join(on_disk, "file", "left_anti").select("page_id")


# M, X: enrichment and what waits for a vector

PLACED = "SELECT id, source_content_id, entity, signal_type, industry, CASE WHEN id % 10 <> 3 THEN id % 10 * 40 END AS char_start, CASE WHEN id % 10 <> 4 THEN id % 10 * 40 + 12 END AS char_end, CASE id % 10 WHEN 1 THEN 'there' WHEN 2 THEN '' END AS enriched_text FROM signals"


def placed(spark, sf):
    signals = view(spark, sf, "signals")
    at = c("id") % 10
    return signals.select(
        "id", "source_content_id", "entity", "signal_type", "industry",
        F.when(at != 3, at * 40).alias("char_start"), F.when(at != 4, at * 40 + 12).alias("char_end"),
        F.when(at == 1, "there").when(at == 2, "").alias("enriched_text"),
    )


@query(
    "m05_backfill",
    f"""{VIEW["signals"]}, p AS ({PLACED}), t AS (SELECT p.*, text, length(text) AS n, greatest(char_start - 250, 0) AS lo, least(char_end + 250, length(text)) AS hi FROM p LEFT JOIN documents d ON d.doc_id = p.source_content_id WHERE coalesce(enriched_text, '') = ''),
    h AS (SELECT *, CASE WHEN lo > 0 AND instr(piece, ' ') BETWEEN 1 AND 30 THEN substring(piece, instr(piece, ' ') + 1) ELSE piece END AS head FROM (SELECT *, substring(text, lo + 1, hi - lo) AS piece FROM t)),
    w AS (SELECT *, CASE WHEN char_start IS NULL OR char_end IS NULL OR coalesce(text, '') = '' OR hi <= lo THEN NULL ELSE trim(CASE WHEN hi < n AND instr(reverse(head), ' ') BETWEEN 1 AND 30 THEN substring(head, 1, length(head) - instr(reverse(head), ' ')) ELSE head END) END AS context FROM h)
    SELECT id, CASE WHEN coalesce(context, '') <> '' THEN 'enriched' ELSE 'skipped' END AS outcome, CASE WHEN coalesce(context, '') <> '' THEN md5(concat(signal_type, CASE WHEN coalesce(industry, '') <> '' THEN concat(' [', industry, ']') ELSE '' END, ' | ', entity, ' — ', context)) END AS digest FROM w""",
)
def m05(spark, sf):
    """Signals without their enriched text, from the text of the document that they come from."""
    texts = docs(spark, sf).select(c("doc_id").alias("source_content_id"), c("text").alias("transcript"))
    window = L.context_window(c("transcript"), c("char_start"), c("char_end"))
    found = M.backfilled(placed(spark, sf), texts, window)
    return found.select("id", "outcome", F.md5(c("enriched_text").cast("binary")).alias("digest"))


@query("m06_described", with_views("signals", then="SELECT id, concat(signal_type, ': ', entity, CASE WHEN id % 2 = 0 THEN concat(' — ', industry) ELSE '' END) AS description FROM signals"))
def m06(spark, sf):
    detail = F.when(c("id") % 2 == 0, c("industry"))
    return view(spark, sf, "signals").select("id", M.described(c("signal_type"), c("entity"), detail).alias("description"))


@query("m08_vectorized", with_views("signals", then="SELECT id, id % 3 = 0 AS vectorized, CASE WHEN id % 3 = 0 THEN '2024-05-02' ELSE '-' END AS vectorized_at FROM (SELECT DISTINCT id FROM signals)"))
def m08(spark, sf):
    """Rows that have a vector now are marked, with the time."""
    ids = view(spark, sf, "signals").select("id").distinct()
    stored = ids.select("id", F.lit(False).alias("vectorized"), F.lit("-").alias("vectorized_at"))
    done = ids.where("id % 3 = 0").select("id", F.lit(True).alias("vectorized"))
    return B.update_by_key(stored, done, "id", F.lit("2024-05-02"), fixed=(), stamp="vectorized_at")


@query("x13_pending_signals", with_views("signals", then="SELECT DISTINCT id FROM signals WHERE id % 3 <> 0"))
def x13(spark, sf):
    """Signals that are not marked, all at once."""
    ids = view(spark, sf, "signals").select("id").distinct()
    state = ids.select("id", F.when(c("id") % 3 == 0, True).when(c("id") % 3 == 1, False).alias("vectorized"))
    return state.where(~F.coalesce("vectorized", F.lit(False))).select("id")


# N, P, V: look-ups, wrappers, exports, metrics

@query("n10_lookup", "SELECT h.hint, coalesce(min(CASE WHEN n.name = h.hint THEN n.name END), min(n.name)) AS name FROM (SELECT DISTINCT concat('d', CAST(vec_id AS STRING)) AS hint FROM embeddings WHERE vec_id % 100 = 0) h JOIN (SELECT concat('d', CAST(doc_id AS STRING)) AS name FROM documents) n ON contains(n.name, h.hint) GROUP BY 1")
def n10(spark, sf):
    names = docs(spark, sf).select(F.concat(F.lit("d"), c("doc_id").cast("string")).alias("name"))
    hints = load(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.concat(F.lit("d"), c("vec_id").cast("string")).alias("hint"))
    return N.looked_up(names, hints)


@query("n11_overview", "SELECT lang, count(*) OVER (PARTITION BY lang) AS n, concat(source, '/', CAST(doc_id AS STRING)) AS name FROM documents")
def n11(spark, sf):
    names = docs(spark, sf).select("lang", F.concat_ws("/", "source", c("doc_id").cast("string")).alias("name"))
    return N.overview(names, "lang", "name")


@query("n12_presented", f"WITH {BM25} SELECT qid, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS digest, CAST(rank AS INT) AS rank FROM bm JOIN documents d ON d.doc_id = bm.doc_id WHERE rank < 5 AND regexp_replace(text, '\\s+', '', 'g') <> ''")
def n12(spark, sf):
    hits = N.bm25(docs(spark, sf), asked(spark, sf), 5)
    texts = docs(spark, sf).select("doc_id", "text").join(N.few(hits), "doc_id")
    return N.presented(texts, "text", metadata=False).select("qid", F.md5(c("text").cast("binary")).alias("digest"), "rank")


@query("n15_signals_index", with_views("signals", then="SELECT count(*) AS n, CAST(sum(length(concat(signal_type, CASE WHEN coalesce(industry, '') <> '' THEN concat(' [', industry, ']') ELSE '' END, ' | ', entity, ' — ', line_status))) AS BIGINT) AS chars, max(len(e.embedding)) AS dim FROM signals s JOIN embeddings e ON e.vec_id = s.source_content_id"))
def n15(spark, sf):
    """Texts of signals, with the vectors of their documents, appended to an index."""
    path = f"{checkpoint_dir(spark)}/lexforge/{uuid.uuid4().hex}"
    vectors = load(spark, sf, "embeddings").select(c("vec_id").alias("source_content_id"), c("embedding").alias("vector"))
    text = M.enriched(c("signal_type"), c("industry"), c("entity"), c("line_status"))
    rows = view(spark, sf, "signals").select("id", "source_content_id", text.alias("text")).join(vectors, "source_content_id")
    files.append_vectors(rows, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.size("vector")).cast("long").alias("dim"))


@query("x22_page_counts", "SELECT d.doc_id, coalesce(CAST(1 + length(p.html) // 3000 AS STRING), 'none') AS pages FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def x22(spark, sf):
    """Documents with the number of pages of their file, "none" without one."""
    counts = load(spark, sf, "pages").select(c("page_id").alias("doc_id"), (1 + F.expr("length(html) div 3000")).cast("string").alias("pages"))
    return docs(spark, sf).select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("pages", F.lit("none")).alias("pages"))


@query(
    "v04_recall_by_kind",
    f"WITH {BM25}, {RELEVANT}, n AS (SELECT qid, count(*) AS n FROM rel GROUP BY 1), k AS (SELECT unnest([1, 3, 5, 10, 20]) AS k), h AS (SELECT n.qid, k.k, n.n, count(bm.doc_id) AS h FROM n CROSS JOIN k LEFT JOIN (SELECT bm.* FROM bm JOIN rel USING (qid, doc_id)) bm ON bm.qid = n.qid AND bm.rank < k.k GROUP BY ALL) SELECT CASE WHEN length(text) < 300 THEN 'short' ELSE 'long' END AS kind, k, count(*) AS queries, round(avg(h / n), 9) AS recall FROM h JOIN benchmark b ON b.item_id = h.qid GROUP BY ALL",
)
def v04(spark, sf):
    """The curve of recall for short and for long passages."""
    met = N.meet(docs(spark, sf).select("doc_id", "text"), asked(spark, sf), ["query"])
    held = met.select("doc_id", F.explode(F.filter("qs", lambda p: F.contains(c("text"), p["query"]))).alias("p"))
    kinds = asked(spark, sf).select("qid", F.when(F.length("query") < 300, "short").otherwise("long").alias("kind"))
    return N.metrics_by(N.bm25(docs(spark, sf), asked(spark, sf), 20), held.select("p.qid", "doc_id"), kinds, (1, 3, 5, 10, 20))


@query(
    "v06_redundancy",
    "WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS w FROM documents) SELECT count(*) AS pairs, round(avg(coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 0)), 9) AS jaccard FROM t a JOIN t b ON b.doc_id = a.doc_id + 1",
)
def v06(spark, sf):
    """Of every document and the one with the next number: a number of pairs that grows with the corpus, not its square."""
    t = docs(spark, sf).select("doc_id", N.terms(c("text")).alias("w"))
    after = t.select((c("doc_id") - 1).alias("doc_id"), c("w").alias("v"))
    return N.redundancy(t.join(after, "doc_id"), c("w"), c("v"))


# R: planners, a discovery run, ingestion records

CATALOGS = """tp AS (SELECT row_number() OVER (ORDER BY p_type) - 1 AS ord, p_type AS name, k AS keywords FROM (SELECT p_type, list_sort(list(DISTINCT p_brand || CASE WHEN p_size > 40 THEN ' extra large' ELSE '' END)) AS k FROM part GROUP BY 1)),
ve AS (SELECT s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN lower(s_name) END AS github_org FROM supplier), sd AS (SELECT n_name AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'plc' ELSE 'mes' END AS category FROM nation),
pg AS (SELECT r_name AS institution, n_name AS program FROM nation JOIN region ON n_regionkey = r_regionkey), si AS (SELECT lower(r_name) AS domain, CASE WHEN r_regionkey > 1 THEN r_name END AS label FROM region)"""


@query(
    "r03_adapter_plan",
    f"""WITH {CATALOGS}, w AS (SELECT name, unnest(keywords[1:3]) AS kw, unnest(range(1, least(len(keywords), 3) + 1)) AS i FROM tp), a AS (
    SELECT 'github' AS adapter, kw AS query, 'topics/' || name AS source_config, 10 AS "limit" FROM w UNION ALL SELECT 'github', 'org:' || github_org, 'vendors/' || name, 10 FROM ve WHERE github_org IS NOT NULL
    UNION ALL SELECT 'rss', name, 'topics/' || name, 20 FROM tp UNION ALL SELECT 'academic', name, 'academic/topic/' || name, 10 FROM tp UNION ALL SELECT 'academic', kw, 'academic/keyword/' || kw, 5 FROM w
    UNION ALL SELECT 'academic', id, 'academic/standards/' || id, 5 FROM sd UNION ALL SELECT 'institution', program || ' ' || name, 'institution/' || institution || '/' || program, 5 FROM pg, tp
    UNION ALL SELECT 'stackoverflow', name, 'stackoverflow/' || name, 10 FROM tp UNION ALL SELECT 'stackoverflow', kw, 'stackoverflow/' || name || '/' || kw, 5 FROM w WHERE i <= 2 AND NOT contains(kw, ' extra large')
    UNION ALL SELECT 'web', name || ' manufacturing automation', 'site_search/' || coalesce(label, domain), 5 FROM si, tp WHERE ord < 3) SELECT adapter, query, source_config, "limit", count(*) AS n FROM a GROUP BY ALL""",
)
def r03(spark, sf):
    """All adapters' plans over catalogs that the given tables hold."""
    part = load(spark, sf, "part")
    brand = F.concat("p_brand", F.when(c("p_size") > 40, " extra large").otherwise(""))
    topics = part.groupBy(c("p_type").alias("name")).agg(F.array_sort(F.collect_set(brand)).alias("keywords"))
    ordered = topics.withColumn("ord", F.row_number().over(Window.orderBy("name")) - 1)  # a catalog of a few topics
    vendors = load(spark, sf, "supplier").select(c("s_name").alias("name"), F.when(c("s_suppkey") % 3 == 0, F.lower("s_name")).alias("github_org"))
    nation, region = load(spark, sf, "nation"), load(spark, sf, "region")
    standards = nation.select(c("n_name").alias("id"), F.when(c("n_nationkey") % 2 == 0, "plc").otherwise("mes").alias("category"))
    programs = nation.join(region, nation.n_regionkey == region.r_regionkey).select(c("r_name").alias("institution"), c("n_name").alias("program"))
    sites = region.select(F.lower("r_name").alias("domain"), F.when(c("r_regionkey") > 1, c("r_name")).alias("label"))
    return R.adapter_plan(ordered, vendors, standards, programs, sites).groupBy(*R.PLAN).agg(F.count(F.lit(1)).alias("n"))


RUN = """f AS (SELECT page_id, lower(url) AS u, coalesce(b.quality, 0) = 1 AS relevant FROM pages p LEFT JOIN labels b ON b.doc_id = p.page_id WHERE contains(lower(html), 'license') OR contains(lower(html), 'the ')),
d AS (SELECT * FROM f WHERE page_id IN (SELECT min(page_id) FROM f GROUP BY u)), k AS (SELECT * FROM d WHERE u NOT IN (SELECT lower(url) FROM pages WHERE page_id % 10 = 0))"""


def discovery_run(spark, sf):
    """Candidates of a search over stored pages, at each stage of a run."""
    pages = load(spark, sf, "pages").select("page_id", F.lower("url").alias("u"), F.lower("html").alias("html"))
    found = pages.where(c("html").contains("license") | c("html").contains("the ")).select("page_id", "u")
    first = D.first_seen(found, "u", "page_id")
    known = pages.where("page_id % 10 = 0").select("u")
    new = first.join(known, "u", "left_anti")
    judged = load(spark, sf, "labels").select(c("doc_id").alias("page_id"), (c("quality") == 1).alias("relevant"), F.lit(0.8).alias("confidence"))
    cache = judged.limit(0)
    return found, first, new, R.classified(new, cache, judged, "page_id")


@query("r05_discovery_run", f"WITH {RUN} SELECT 'found' AS stage, count(*) AS n FROM f UNION ALL SELECT 'distinct', count(*) FROM d UNION ALL SELECT 'new', count(*) FROM k UNION ALL SELECT 'approved', count_if(relevant) FROM k UNION ALL SELECT 'rejected', count_if(NOT relevant) FROM k")
def r05(spark, sf):
    """Plan and cache give the pages; then duplicates, known URLs and the judge; counts of each stage."""
    found, first, new, judged = discovery_run(spark, sf)
    stages = {"found": found, "distinct": first, "new": new, "approved": judged.where("approved"), "rejected": judged.where("not approved")}
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in stages.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


@query(
    "r07_ingestion",
    "SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'pub' END AS publisher, CASE page_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'podcast' ELSE 'web' END AS source_type, CASE WHEN page_id % 3 < 2 THEN url || '/feed' END AS feed_url, CASE WHEN page_id % 2 = 0 THEN 'arxiv' ELSE '' END AS provider, CASE WHEN page_id % 4 = 0 THEN 'unknown' ELSE 'expert' END AS authority, 0.8::DOUBLE AS confidence FROM pages",
)
def r07(spark, sf):
    n, url = c("page_id"), c("url")
    kind = F.struct(F.lit("paper").alias("doc_type"), F.lit(0.8).alias("confidence"), F.lit("r").alias("reason"), F.lit(None).cast("array<string>").alias("topic_tags"), F.when(n % 4 != 0, "expert").otherwise("").alias("authority_guess"))
    raw = F.struct(F.concat(url, F.lit("/feed")).alias("feed_url"), F.when(n % 2 == 0, "arxiv").alias("provider"), F.lit(None).cast("string").alias("pdf_url"))
    rows = load(spark, sf, "pages").select(
        url, n.cast("string").alias("title"), F.when(n % 3 != 0, "pub").alias("publisher"),
        F.when(n % 3 == 0, "rss").when(n % 3 == 1, "podcast").otherwise("web").alias("source_type"), F.lit(None).cast("string").alias("snippet"),
        F.lit("web").alias("adapter"), F.lit(None).cast("string").alias("query_used"), kind.alias("classification"), raw.alias("raw"),
    )
    out = R.ingestion_records(rows, F.lit("2024-05-01"))
    return out.select(c("title").cast("long").alias("page_id"), "url", "publisher", "source_type", "feed_url", "provider", "authority", "confidence")


@query(
    "e27_topics",
    with_views("content", then="SELECT 'topic' AS kind, name, n FROM (SELECT name, count(*) AS n FROM (SELECT source_name AS name FROM content WHERE id % 7 <> 0 UNION ALL SELECT language FROM content WHERE id % 7 <> 0) GROUP BY 1 ORDER BY n DESC, name LIMIT 20) UNION ALL SELECT 'total', 'all', count(*) FROM content"),
)
def e27_topics(spark, sf):
    """The most frequent tags, some of which are no JSON, and the total."""
    content = view(spark, sf, "content")
    tags = F.when(c("id") % 7 == 0, "[broken").otherwise(F.to_json(F.array("source_name", "language")))
    total = content.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit("all").alias("name"), "n")
    return A.tag_counts(content, tags, 20).select(F.lit("topic").alias("kind"), "name", "n").unionByName(total)


@query(
    "p06_export",
    f"""WITH {NN}, cut AS (SELECT quantile_cont(similarity, 0.95) AS c FROM nn) SELECT 'document' AS kind, CAST(id AS STRING) AS name, CAST(label AS STRING) AS label, round(similarity, 6) AS value FROM nn JOIN embeddings e ON e.vec_id = nn.id
    UNION ALL SELECT 'cluster', CAST(label AS STRING), CAST(label AS STRING), CAST(count(*) AS DOUBLE) FROM embeddings GROUP BY label UNION ALL SELECT 'threshold', 'near duplicate', '', round(c, 6) FROM cut""",
)
def p06(spark, sf):
    """The map's export as rows: each document with its cluster and how near its neighbour is, clusters with their sizes, and the
    threshold of near-duplicates."""
    vectors = load(spark, sf, "embeddings").select(c("vec_id").alias("id"), c("label").cast("string").alias("label"))
    near = neighbours(spark, sf)
    documents = near.join(vectors, "id").select(F.lit("document").alias("kind"), c("id").cast("string").alias("name"), "label", F.round("similarity", 6).alias("value"))
    clusters = vectors.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("cluster").alias("kind"), c("label").alias("name"), "label", "value")
    cut = spark.range(1).select(F.lit("threshold").alias("kind"), F.lit("near duplicate").alias("name"), F.lit("").alias("label"), F.round(F.lit(P.at_quantile(near, "similarity", 0.95)).cast("double"), 6).alias("value"))
    return documents.unionByName(clusters).unionByName(cut)
