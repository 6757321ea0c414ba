"""Queries of the scalar functions, over strings that the given tables hold or make up."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import parsing as S
from lexforge.functions import web as W
from lexforge.plans.tables import load
from lexforge.registry import query
from lexforge.sources.views import view, with_views

c = F.col


def pages(spark, sf):
    return load(spark, sf, "pages")


TRACKED = ", ".join(f"'{t}'" for t in W.TRACKING)
NORMAL_URLS = f"""parts AS (SELECT page_id, regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?', ['scheme', 'host', 'path', 'query']) AS u FROM pages),
pairs AS (SELECT page_id, i, url_decode(replace(string_split(p, '=')[1], '+', ' ')) AS k, url_decode(replace(substring(p, instr(p, '=') + 1), '+', ' ')) AS v FROM (SELECT page_id, unnest(string_split(u.query, '&')) AS p, generate_subscripts(string_split(u.query, '&'), 1) AS i FROM parts) WHERE instr(p, '=') > 0),
kept AS (SELECT page_id, string_agg(replace(url_encode(k), '%20', '+') || '=' || replace(url_encode(v), '%20', '+'), '&' ORDER BY k, i) AS q FROM pairs WHERE v <> '' AND lower(k) NOT IN ({TRACKED}) GROUP BY 1),
normal AS (SELECT parts.page_id, lower(u.scheme) || '://' || regexp_replace(lower(u.host), '^www[.]', '') || regexp_replace(regexp_replace(u.path, ';[^/]*$', ''), '/+$', '') || coalesce('?' || q, '') AS url FROM parts LEFT JOIN kept ON parts.page_id = kept.page_id)"""


@query("i01_normalize_url", f"WITH {NORMAL_URLS} SELECT page_id, url FROM normal")
def i01(spark, sf):
    return pages(spark, sf).select("page_id", W.normalize_url("url").alias("url"))


@query("d06_known_urls", f"WITH {NORMAL_URLS} SELECT page_id FROM normal WHERE page_id % 2 = 1 AND url NOT IN (SELECT url FROM normal WHERE page_id % 2 = 0)")
def d06(spark, sf):
    """New pages whose normalised URL is not known."""
    keyed = pages(spark, sf).select("page_id", W.normalize_url("url").alias("u"))
    return keyed.where("page_id % 2 = 1").join(keyed.where("page_id % 2 = 0").select("u"), "u", "left_anti").select("page_id")


@query("i03_titles", with_views("candidates", then="SELECT ord, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s]', '', 'g')) AS title FROM candidates"))
def i03(spark, sf):
    return view(spark, sf, "candidates").select("ord", S.normalized_title(c("title")).alias("title"))


@query("i04_file_names", with_views("candidates", then="SELECT ord, trim(regexp_replace(regexp_replace(title, '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '\\s+', '_', 'g'), '_') AS name FROM candidates"))
def i04(spark, sf):
    return view(spark, sf, "candidates").select("ord", S.file_name(c("title")).alias("name"))


@query("i05_strip_tags", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages")
def i05(spark, sf):
    return pages(spark, sf).select("page_id", F.md5(W.strip_tags(c("html")).cast("binary")).alias("digest"))


@query("i07_domain", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS domain FROM pages")
def i07(spark, sf):
    return pages(spark, sf).select("page_id", W.domain(c("url")).alias("domain"))


@query("i09_cache_key", "SELECT item_id, substring(sha256('web:' || trim(text)), 1, 32) AS key FROM benchmark")
def i09(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", S.cache_key(F.lit(" Web"), c("text")).alias("key"))


@query("i10_durations", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id % 3 * 3600 + user_id % 60 * 60 + 5 AS DOUBLE) WHEN 1 THEN CAST(user_id % 60 * 60 + 7 AS DOUBLE) WHEN 2 THEN CAST(user_id AS DOUBLE) END AS seconds FROM events")
def i10(spark, sf):
    u = c("user_id")
    text = F.when(c("event_id") % 4 == 0, F.concat_ws(":", u % 3, u % 60, F.lit("05"))).when(c("event_id") % 4 == 1, F.concat_ws(":", u % 60, F.lit("7"))).when(c("event_id") % 4 == 2, u.cast("string")).otherwise("unknown")
    return load(spark, sf, "events").select("event_id", S.seconds(text).alias("seconds"))


@query("i13_nul", "SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def i13(spark, sf):
    dirty = F.concat(F.substring("text", 1, 5), F.lit("\u0000"), F.expr("substring(text, 6)"))
    return load(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(S.without_nul(dirty))).alias("chars"))


@query("i14_json", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, -1 FROM events WHERE event_id % 5 = 0")
def i14(spark, sf):
    """What is no JSON reads as no value."""
    props = F.when(c("event_id") % 5 == 0, F.concat(F.lit("{"), c("props"))).otherwise(c("props"))
    return load(spark, sf, "events").select("event_id", F.coalesce(F.from_json(props, "k bigint")["k"], F.lit(-1)).alias("k"))


SAID = "CASE turn % 4 WHEN 0 THEN 'QUERY: ' || text || chr(10) || 'ROUTE: ' || role || ' and plc_expert' WHEN 1 THEN text || chr(10) || ' route: Analytics_Agent, technical_document_agent' WHEN 2 THEN text || ' direct_reply' ELSE text END"


def said(spark, sf):
    """Turns as a router may put them; their texts come from the table."""
    t = load(spark, sf, "conversations")
    routes = F.when(c("turn") % 4 == 0, F.concat(F.lit("QUERY: "), "text", F.lit("\nROUTE: "), "role", F.lit(" and plc_expert")))
    routes = routes.when(c("turn") % 4 == 1, F.concat("text", F.lit("\n route: Analytics_Agent, technical_document_agent"))).when(c("turn") % 4 == 2, F.concat("text", F.lit(" direct_reply"))).otherwise(c("text"))
    return t.select("conv_id", "turn", "text", routes.alias("said"))


NAMED = ", ".join(f"CASE WHEN contains(s, '{e}') THEN '{e}' END" for e in S.EXPERTS)


@query(
    "i17_router",
    f"""SELECT conv_id, turn, CASE WHEN named <> '' THEN named WHEN contains(s, '{S.SMALL_TALK}') THEN '{S.SMALL_TALK}' ELSE '{S.EXPERTS[0]}' END AS experts
    FROM (SELECT *, concat_ws(',', {NAMED}) AS named FROM (SELECT conv_id, turn, lower(CASE WHEN regexp_matches(said, '(?im)^\\s*route:') THEN regexp_extract(said, '(?im)^\\s*route:(.*)$', 1) ELSE said END) AS s FROM (SELECT *, {SAID} AS said FROM conversations)))""",
)
def i17(spark, sf):
    return said(spark, sf).select("conv_id", "turn", F.array_join(S.routed(c("said")), ",").alias("experts"))


BARE_TEXT = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query(
    "i18_used_context",
    f"SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 2 OR {BARE_TEXT} = '' THEN raw ELSE {BARE_TEXT} END) AS digest, turn % 3 <> 1 AS used FROM (SELECT *, CASE turn % 3 WHEN 0 THEN text || chr(10) || 'USED_CONTEXT: true ' || chr(10) WHEN 1 THEN text || chr(10) || 'used_context: FALSE' ELSE text END AS raw FROM conversations)",
)
def i18(spark, sf):
    """Answers that end with the marker, in any case, and some without."""
    t = load(spark, sf, "conversations")
    raw = F.when(c("turn") % 3 == 0, F.concat("text", F.lit("\nUSED_CONTEXT: true \n"))).when(c("turn") % 3 == 1, F.concat("text", F.lit("\nused_context: FALSE"))).otherwise(c("text"))
    answer, used = S.used_context(raw)
    return t.select("conv_id", "turn", F.md5(answer.cast("binary")).alias("digest"), used.alias("used"))


@query("i19_chart", "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'bar' WHEN 1 THEN 'line' END AS chart FROM conversations")
def i19(spark, sf):
    """The chart line stands after, before, or in the middle of what a turn says."""
    line = F.when(c("turn") % 4 == 0, F.concat("text", F.lit("\nCHART: yes | bar\n"), "role")).when(c("turn") % 4 == 1, F.concat(F.lit("chart: YES|line\n"), "text"))
    raw = line.when(c("turn") % 4 == 2, F.concat("text", F.lit("\nCHART: none"))).otherwise(F.concat("text", F.lit("\nCHART: yes | pie")))
    return load(spark, sf, "conversations").select("conv_id", "turn", S.chart_type(raw).alias("chart"))


@query("i20_errors", with_views("attempts", then="SELECT id, CASE WHEN error_type = '403' THEN 'safety_filter' WHEN error_type = 'timeout' THEN 'timeout' ELSE 'other' END AS class FROM attempts"))
def i20(spark, sf):
    message = F.when(c("error_type") == "403", "403 Blocked by host").when(c("error_type") == "timeout", "Read Timeout").otherwise("fine")
    return view(spark, sf, "attempts").select("id", S.error_class(message).alias("class"))


@query(
    "i20_typed_errors",
    """WITH m AS (SELECT event_id, lower(props) AS m, CASE event_id % 6 WHEN 0 THEN 'Timeout' WHEN 1 THEN 'ConnectionError' WHEN 2 THEN 'HTTPError' WHEN 3 THEN event_type END AS kind, 395 + user_id % 140 AS status, event_type FROM events),
    x AS (SELECT *, concat(event_type, CASE user_id_ % 4 WHEN 0 THEN ' rate limit ' WHEN 1 THEN ' resource exhausted ' WHEN 2 THEN ' cannot parse ' ELSE ' ' END, m) AS msg FROM (SELECT m.*, status - 395 AS user_id_ FROM m))
    SELECT event_id, CASE WHEN kind = 'Timeout' THEN 'timeout' WHEN kind = 'ConnectionError' THEN 'connection_error' WHEN kind = 'HTTPError' THEN CASE WHEN status = 429 THEN 'rate_limit' WHEN status >= 500 THEN 'server_error' ELSE concat('http_', CAST(status AS STRING)) END
    WHEN contains(msg, 'rate') AND contains(msg, 'limit') THEN 'rate_limit' WHEN contains(msg, 'quota') THEN 'quota_exceeded' WHEN contains(msg, 'timeout') THEN 'timeout' WHEN contains(msg, 'resource') AND contains(msg, 'exhausted') THEN 'quota_exceeded'
    WHEN contains(msg, 'json') OR contains(msg, 'parse') OR contains(msg, 'decode') THEN 'parse_error' WHEN contains(msg, 'safety') OR contains(msg, 'blocked') THEN 'safety_filter' ELSE kind END AS class FROM x""",
)
def i20_typed(spark, sf):
    """Kinds, status codes and messages of the events; without any hint an error keeps its kind, if it has one."""
    e = load(spark, sf, "events")
    n, user = c("event_id") % 6, c("user_id") % 140
    kind = F.when(n == 0, "Timeout").when(n == 1, "ConnectionError").when(n == 2, "HTTPError").when(n == 3, c("event_type"))
    hint = F.when(user % 4 == 0, " rate limit ").when(user % 4 == 1, " resource exhausted ").when(user % 4 == 2, " cannot parse ").otherwise(" ")
    return e.select("event_id", S.error_class(F.concat("event_type", hint, "props"), kind, user + 395).alias("class"))


@query("i25_collapse", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\\n\\s*\\n', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'))) AS digest FROM documents")
def i25(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(W.collapse(c("text")).cast("binary")).alias("digest"))


@query("i27_ratios", "SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 100) AS DOUBLE) AS ratio FROM lineitem")
def i27(spark, sf):
    message = F.format_string("saved %.1f%% of size: %d", F.round(c("l_discount") * 100), c("l_linenumber"))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.regexp_extract(message, "([\\d.]+)%", 1).try_cast("double").alias("ratio"))


@query(
    "i27_messages",
    "SELECT l_orderkey, l_linenumber, round(round(l_discount * 100, 1) / 100, 9) AS ratio, CASE WHEN l_linenumber % 2 = 0 THEN round(l_tax, 4) END AS diversity FROM lineitem",
)
def i27_messages(spark, sf):
    """Both forms in one message: a share in percent, and in every second one a number behind a colon."""
    said = F.when(c("l_linenumber") % 2 == 0, F.format_string("diversity: %.4f", c("l_tax"))).otherwise(F.lit("diversity unknown"))
    message = F.concat(F.format_string("boilerplate at %.1f%% of lines, ", F.round(c("l_discount") * 100, 1)), said)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.ratio_of(message), 9).alias("ratio"), S.value_of(message).alias("diversity"))


@query("a04_file_types", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'text' WHEN 2 THEN 'audio' ELSE 'unknown' END AS type FROM events")
def a04(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, (".PDF", ".md", ".mp4", ".zip"))), (c("event_id") % 4 + 1).cast("int"))
    return load(spark, sf, "events").select("event_id", W.file_type(F.concat(F.lit("/x/y.z/"), c("event_id").cast("string"), ext)).alias("type"))


@query("a06_content_types", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' ELSE 'unknown' END AS type FROM pages")
def a06(spark, sf):
    url = F.when(c("page_id") % 3 == 0, "http://h/a%2Eb.pdf?x=1.html").otherwise(F.lit("http://h/a"))
    header = F.when(c("page_id") % 3 == 1, "text/HTML; charset=utf-8")
    return pages(spark, sf).select("page_id", W.content_type(url, header).alias("type"))


@query("a11_pdf_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def a11(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", S.pdf_date(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("Z"))).alias("day"))


@query("a17_keyword_scan", "SELECT page_id FROM pages WHERE contains(lower(html), 'license') OR contains(lower(html), 'apache') ORDER BY page_id LIMIT 20")
def a17(spark, sf):
    low = F.lower("html")
    return pages(spark, sf).where(low.contains("license") | low.contains("apache")).select("page_id").orderBy("page_id").limit(20)


@query("a20_inverted_text", "SELECT doc_id, md5(string_agg(w, ' ' ORDER BY i)) AS digest FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM documents)) GROUP BY 1")
def a20(spark, sf):
    """From (token, places) back to a text: an index of whole documents is built and undone; of several tokens at a
    place the first wins."""
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    index = load(spark, sf, "documents").select("doc_id", F.posexplode(words).alias("i", "w")).groupBy("doc_id", "w").agg(F.collect_list("i").alias("places"))
    placed = index.select("doc_id", F.explode("places").alias("i"), "w").groupBy("doc_id", "i").agg(F.min("w").alias("w"))
    return placed.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), " ").cast("binary")).alias("digest"))


@query("a23_first_keyword", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN substring(text, instr(lower(text), 'license'), 7) WHEN contains(lower(text), 'the') THEN substring(text, instr(lower(text), 'the'), 3) ELSE substring(text, 1, 10) END AS word FROM documents")
def a23(spark, sf):
    text = c("text")
    found = S.first_keyword(text, ("license", "the"))
    return load(spark, sf, "documents").select("doc_id", F.when(F.lower(text).contains("license") | F.lower(text).contains("the"), found).otherwise(F.substring(text, 1, 10)).alias("word"))


@query("a13_html_extract")
def a13(spark, sf):
    """Title and text of every page."""
    return pages(spark, sf).select("page_id", W.extract_article("html").alias("a")).select("page_id", "a.title", "a.text")


@query("i23_page_metadata", "SELECT page_id, 'T' || CAST(page_id AS STRING) AS title, CASE WHEN page_id % 2 = 0 THEN lang ELSE '' END AS author, '2024-01-0' || CAST(page_id % 9 + 1 AS STRING) AS published FROM (SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages)")
def i23(spark, sf):
    """Metadata put into the heads of the given pages."""
    n = c("page_id").cast("string")
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    date = F.concat(F.lit("2024-01-0"), (c("page_id") % 9 + 1).cast("string"))
    author = F.when(c("page_id") % 2 == 0, F.concat(F.lit('<meta name="author" content="'), lang, F.lit('">'))).otherwise("")
    head = F.concat(F.lit('<head><meta property="og:title" content="T'), n, F.lit('">'), author, F.lit('<meta name="datePublished" content="'), date, F.lit('">'))
    marked = F.replace(c("html"), F.lit("<head>"), head)
    return pages(spark, sf).select("page_id", W.page_metadata(marked).alias("m")).select("page_id", "m.title", "m.author", "m.published")


@query("a33_list_items", with_views("content", then="SELECT id, title, content_type FROM content WHERE content_type = 'html' ORDER BY id LIMIT 20"))
def a33(spark, sf):
    """Raw SQL with parameters over a view."""
    return spark.sql("SELECT id, title, content_type FROM {content} WHERE content_type = :kind ORDER BY id LIMIT 20", args={"kind": "html"}, content=view(spark, sf, "content"))
