"""Queries of retrieval, its metrics and the corpus map."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import chunking as L
from lexforge.operators import corpus_map as P
from lexforge.operators import embedding as E
from lexforge.operators import inverted, layout
from lexforge.operators import retrieval as N
from lexforge.plans.fragments import FOLD, SENTENCES
from lexforge.plans.tables import folder, load
from lexforge.registry import query
from lexforge.sources.views import view, with_views

c = F.col
STOP = ("the", "and", "for", "with", "that", "this", "are", "was", "from")


CHUNKED = FOLD.format(sentences=SENTENCES)


def docs(spark, sf):
    return load(spark, sf, "documents")


def asked(spark, sf):
    """The benchmark's passages as queries."""
    return load(spark, sf, "benchmark").select(c("item_id").alias("qid"), c("text").alias("query"))


def vectors(spark, sf):
    return load(spark, sf, "embeddings").select(c("vec_id").alias("doc_id"), c("embedding").alias("v"))


def vector_queries(spark, sf):
    return vectors(spark, sf).where("doc_id % 50 = 0").select(c("doc_id").alias("qid"), "v")


TERMS = "list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> '')"
BM25 = f"""po AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS.format(x="text")}) AS term FROM documents) GROUP BY ALL),
sz AS (SELECT doc_id, len({TERMS.format(x="text")}) AS n FROM documents), st AS (SELECT count(*) AS docs, avg(n) AS avgdl FROM sz),
df AS (SELECT term, count(*) AS df FROM po GROUP BY 1), idf0 AS (SELECT term, ln(docs - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS i FROM df, st), idf AS (SELECT term, CASE WHEN i < 0 THEN 0.25 * (SELECT avg(i) FROM idf0) ELSE i END AS idf FROM idf0),
q AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest({TERMS.format(x="text")}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT qid, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avgdl))), 9) AS score FROM q JOIN po USING (term) JOIN idf USING (term) JOIN sz USING (doc_id), st GROUP BY ALL),
bm AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1 AS rank FROM sc WHERE score > 0)"""


@query("n05_bm25", f"WITH {BM25} SELECT qid, doc_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM bm WHERE rank < 10")
def n05(spark, sf):
    return N.bm25(docs(spark, sf), asked(spark, sf), 10).withColumn("score", F.round("score", 6))


@query("n05_index", f"WITH {BM25} SELECT qid, doc_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM bm WHERE rank < 10")
def n05_index(spark, sf):
    """The same from a written index."""
    index = inverted.Index(spark, folder(spark)).build(docs(spark, sf))
    return index.search(asked(spark, sf), 10).withColumn("score", F.round("score", 6))


NORM = "list_transform(list_transform({x}, lambda x: x::DOUBLE), lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END)"
COSINE = """v AS (SELECT vec_id, list_transform(e, lambda x: x / CASE WHEN sqrt(list_dot_product(e, e)) = 0 THEN 1 ELSE sqrt(list_dot_product(e, e)) END) AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)),
cs AS (SELECT q.vec_id AS qid, v.vec_id AS doc_id, round(list_dot_product(q.v, v.v), 6) AS score FROM v q, v WHERE q.vec_id % 50 = 0),
cr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1 AS rank FROM cs)"""


@query("n02_cosine", f"WITH {COSINE} SELECT qid, score FROM cr WHERE rank < 10")
def n02(spark, sf):
    return N.cosine(vectors(spark, sf), vector_queries(spark, sf), 10).select("qid", F.round("score", 6).alias("score"))


@query("n04_adaptive", f"WITH {COSINE} SELECT qid, score FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM cr WHERE rank < 10 AND rank > 0) WHERE score >= CASE WHEN top >= 0.5 THEN 0.5 ELSE 0.375 END")
def n04(spark, sf):
    """Top k first, then the threshold, relaxed for queries that have none (each query's own vector left out)."""
    best = N.cosine(vectors(spark, sf), vector_queries(spark, sf), 10).where("rank > 0")
    top = F.max(F.round("score", 6)).over(N.Window.partitionBy("qid"))
    return best.withColumn("score", F.round("score", 6)).withColumn("f", F.when(top >= 0.5, 0.5).otherwise(0.375)).where("score >= f").select("qid", "score")


def vector_of_query(spark, sf):
    """A passage's vector is that of its number."""
    return asked(spark, sf).join(vectors(spark, sf).select(c("doc_id").alias("qid"), "v"), "qid")


DENSE = """nv AS (SELECT vec_id, list_transform(e, lambda x: x / CASE WHEN sqrt(list_dot_product(e, e)) = 0 THEN 1 ELSE sqrt(list_dot_product(e, e)) END) AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)),
ds AS (SELECT b.item_id AS qid, v.vec_id AS doc_id, round(list_dot_product(q.v, v.v), 9) AS score FROM benchmark b JOIN nv q ON q.vec_id = b.item_id, nv v),
de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1 AS rank FROM ds) WHERE score >= 0)"""
LISTS = "l AS (SELECT qid, doc_id, rank, score, 'bm25' AS source FROM bm WHERE rank < {n} AND qid IN (SELECT vec_id FROM embeddings) UNION ALL SELECT qid, doc_id, rank, score, 'dense' FROM de WHERE rank < {n})"


@query("n06_rrf", f"WITH {BM25}, {DENSE}, {LISTS.format(n=20)} SELECT qid, doc_id AS key, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS rrf FROM l GROUP BY ALL")
def n06(spark, sf):
    """A dense and a lexical list of each passage, fused by their documents."""
    queries = vector_of_query(spark, sf)
    lexical = N.bm25(docs(spark, sf), queries, 20).withColumn("source", F.lit("bm25"))
    dense = N.cosine(vectors(spark, sf), queries.select("qid", "v"), 20, threshold=0.0).withColumn("source", F.lit("dense"))
    lists = lexical.unionByName(dense)
    return N.fused(lists.select("qid", c("doc_id").alias("key"), "source", "rank", "score")).select("qid", "key", F.round("rrf", 9).alias("rrf"))


def dated(spark, sf):
    return view(spark, sf, "content").select(c("id").alias("doc_id"), c("transcript").alias("text"), F.to_date("created_at").alias("published"))


NOW, DECAY = "2024-03-01", 0.01
HYBRID = f"""hl AS (SELECT l.*, md5(c.transcript) AS key, CAST(c.created_at AS DATE) AS published FROM l JOIN content c ON c.id = l.doc_id),
hf AS (SELECT qid, key, min(doc_id) AS doc_id, max(published) AS published, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS rrf, min(CASE WHEN source = 'dense' THEN rank ELSE 1000000 + rank END) AS first,
coalesce(max_by(CASE WHEN source = 'dense' THEN score END, CASE WHEN source = 'dense' THEN rank END), 0) AS dense_score FROM hl GROUP BY ALL),
hs AS (SELECT *, round(rrf * exp(-{DECAY} * greatest(date_diff('day', published, DATE '{NOW}'), 0)), 12) AS score FROM hf),
hy AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, doc_id) - 1 AS rank FROM hs)"""
HYBRID_VIEW = with_views("content", then="SELECT 1").removesuffix("SELECT 1").rstrip()


@query("n07_hybrid", f"{HYBRID_VIEW}, {BM25}, {DENSE}, {LISTS.format(n=100)}, {HYBRID} SELECT qid, doc_id, CAST(rank AS INT) AS rank, round(score, 9) AS score, round(dense_score, 6) AS dense_score FROM hy WHERE rank < 10")
def n07(spark, sf):
    """Dense and lexical lists of each passage, fused by text, the newer the better, ten of each."""
    found = N.hybrid(dated(spark, sf), vectors(spark, sf), vector_of_query(spark, sf), 10, F.lit(NOW).cast("date"), DECAY)
    return found.select("qid", "doc_id", "rank", F.round("score", 9).alias("score"), F.round("dense_score", 6).alias("dense_score"))


PLACED = """{x}t AS (SELECT id, w, count(*) AS tf FROM (SELECT {id} AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {table}) GROUP BY ALL),
{x}h AS (SELECT id, tf, ('0x' || substring(md5(w), 1, 8))::UBIGINT::BIGINT AS h FROM {x}t),
{x}c AS (SELECT id, CAST(h % 384 AS INT) AS i, sum(CASE WHEN (h // 384) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (1 + ln(tf))) AS x FROM {x}h GROUP BY ALL),
{x}v AS (SELECT id, i, x / CASE WHEN sum(x * x) OVER (PARTITION BY id) = 0 THEN 1 ELSE sqrt(sum(x * x) OVER (PARTITION BY id)) END AS x FROM {x}c)"""
DOC_PLACED, ASKED_PLACED = PLACED.format(x="d", id="doc_id", table="documents"), PLACED.format(x="q", id="item_id", table="benchmark")


@query("n01_embedded", f"WITH {DOC_PLACED} SELECT id AS doc_id, i, round(x, 6) AS x FROM dv WHERE round(x, 6) <> 0")
def n01(spark, sf):
    """What is not zero of each document's own vector."""
    found = E.embedded(docs(spark, sf), "doc_id", "text").select("doc_id", F.posexplode("v").alias("i", "x"))
    return found.withColumn("x", F.round("x", 6)).where("x <> 0")


@query(
    "n02_text_queries",
    f"""WITH {DOC_PLACED}, {ASKED_PLACED}, s AS (SELECT q.id AS qid, d.id AS doc_id, round(sum(q.x * d.x), 6) AS score FROM qv q JOIN dv d USING (i) GROUP BY ALL)
    SELECT qid, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC) AS r FROM s) WHERE r <= 10""",
)
def n02_text(spark, sf):
    """Passages as texts against documents as texts: both have vectors of their own."""
    queries = E.embedded(asked(spark, sf), "qid", "query")
    return N.cosine(E.embedded(docs(spark, sf), "doc_id", "text"), queries, 10).select("qid", F.round("score", 6).alias("score"))


GROUNDED = """g AS (SELECT qid, doc_id % 50 AS content_id, doc_id AS chunk, score, rank, dense_score FROM hy WHERE rank < 100),
gb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, content_id ORDER BY score DESC, rank) AS r FROM g) WHERE r = 1),
gr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS place FROM gb),
gf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS n FROM gr WHERE dense_score >= 0.3)"""


@query("n08_grounded", f"{HYBRID_VIEW}, {BM25}, {DENSE}, {LISTS.format(n=1000)}, {HYBRID.replace('round(rrf * exp', 'round(rrf + 0 * exp')}, {GROUNDED} SELECT qid, content_id, chunk, CAST(place AS INT) AS rank, round(score, 9) AS score FROM gf WHERE n <= 5")
def n08(spark, sf):
    """The passage itself stands for its rewriting; a hundred chunks by hybrid search, the best of each document (here every
    fiftieth number belongs to one), those under a dense floor dropped after ranking."""
    found = N.hybrid(docs(spark, sf), vectors(spark, sf), vector_of_query(spark, sf), 100)
    hits = found.select("qid", (c("doc_id") % 50).alias("content_id"), c("doc_id").alias("chunk"), c("rank").alias("pos"), "score", "dense_score")
    return N.grounded(hits, 5, floor=0.3).select("qid", "content_id", "chunk", c("rank").cast("int").alias("rank"), F.round("score", 9).alias("score"))


@query("n08_own_vectors")
def n08_own(spark, sf):
    """The same with vectors of the texts themselves, of passages and documents alike: nothing is borrowed by a number."""
    queries = asked(spark, sf).join(E.embedded(asked(spark, sf), "qid", "query"), "qid")
    found = N.hybrid(docs(spark, sf), E.embedded(docs(spark, sf), "doc_id", "text"), queries, 100)
    hits = found.select("qid", (c("doc_id") % 50).alias("content_id"), c("doc_id").alias("chunk"), c("rank").alias("pos"), "score", "dense_score")
    return N.grounded(hits, 5, floor=0.3).select("qid", "content_id", "chunk", c("rank").cast("int").alias("rank"), F.round("score", 9).alias("score"))


@query("f03_best_chunk", "SELECT qid, content_id, chunk, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS INT) AS rank FROM (SELECT l_suppkey AS qid, l_orderkey AS content_id, l_linenumber AS chunk, l_quantity AS score, l_orderkey * 10 + l_linenumber AS pos, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def f03(spark, sf):
    line = load(spark, sf, "lineitem")
    hits = line.select(c("l_suppkey").alias("qid"), c("l_orderkey").alias("content_id"), c("l_linenumber").alias("chunk"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("pos"), c("l_quantity").alias("score"))
    return N.best_chunks(hits)


@query("n09_keywords", "SELECT qid, name, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, name) AS r FROM (SELECT q.qid, d.name, len(list_filter(ws, lambda w: contains(d.hay, w))) + CASE WHEN list_contains(ws, lower(d.name)) THEN 1000 ELSE 0 END AS score FROM (SELECT item_id AS qid, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: length(w) > 2 AND w NOT IN (" + ",".join(f"'{w}'" for w in N.STOPWORDS) + "))) AS ws FROM benchmark) q, (SELECT concat('d', CAST(doc_id AS STRING)) AS name, lower(concat_ws(' ', concat('d', CAST(doc_id AS STRING)), text)) AS hay FROM documents) d) WHERE score > 0) WHERE r <= 3")
def n09(spark, sf):
    named = docs(spark, sf).select(F.concat(F.lit("d"), c("doc_id").cast("string")).alias("name"), c("text").alias("content"))
    return N.keyword_overlap(named, asked(spark, sf), N.STOPWORDS, 3).select("qid", "name", c("score").cast("long").alias("score"))


RELEVANT = "rel AS (SELECT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query("v01_metrics", f"WITH {BM25}, {RELEVANT}, n AS (SELECT qid, count(*) AS n FROM rel GROUP BY 1), k AS (SELECT unnest([1, 3, 5, 10]) AS k), h AS (SELECT n.qid, k.k, n.n, count(bm.doc_id) AS h, min(bm.rank) AS f FROM n CROSS JOIN k LEFT JOIN (SELECT bm.* FROM bm JOIN rel USING (qid, doc_id)) bm ON bm.qid = n.qid AND bm.rank < k.k GROUP BY ALL) SELECT k, count(*) AS queries, round(avg(h / n), 9) AS recall, round(avg(h / k), 9) AS precision, round(avg(coalesce(1 / (f + 1), 0)), 9) AS mrr FROM h GROUP BY 1")
def v01(spark, sf):
    """Recall, precision and reciprocal rank of BM25; relevant are the documents that hold a passage word for word. They are
    found in one pass: blocks of passages meet each document."""
    met = N.meet(docs(spark, sf).select("doc_id", "text"), asked(spark, sf), ["query"])
    held = met.select("doc_id", F.explode(F.filter("qs", lambda p: F.contains(F.col("text"), p["query"]))).alias("p"))
    return N.metrics(N.bm25(docs(spark, sf), asked(spark, sf), 10), held.select("p.qid", "doc_id"), (1, 3, 5, 10))


@query("v05_entropy", f"SELECT round(-sum(p * ln(p)) / ln(2), 6) AS bits FROM (SELECT n / sum(n) OVER () AS p FROM (SELECT term, count(*) AS n FROM (SELECT unnest({TERMS.format(x='text')}) AS term FROM documents) GROUP BY 1))")
def v05(spark, sf):
    words = docs(spark, sf).select(F.explode(N.terms(c("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return N.entropy(words, "n")


@query("v09_boundaries", "SELECT round(avg(CASE WHEN regexp_matches(text, '^[A-ZÀ-ÖØ-Þ]') THEN 1.0::DOUBLE ELSE 0 END), 9) AS starts, round(avg(CASE WHEN regexp_matches(text, '[.?!]$') THEN 1.0::DOUBLE ELSE 0 END), 9) AS ends FROM documents")
def v09(spark, sf):
    starts, ends = c("text").rlike("^[A-ZÀ-ÖØ-Þ]"), c("text").rlike("[.?!]\\z")
    return docs(spark, sf).agg(F.round(F.avg(starts.cast("int").cast("double")), 9).alias("starts"), F.round(F.avg(ends.cast("int").cast("double")), 9).alias("ends"))


@query("v09_chunk_boundaries", CHUNKED + " SELECT round(avg(CASE WHEN regexp_matches(t, '^[A-ZÀ-ÖØ-Þ]') THEN 1.0::DOUBLE ELSE 0 END), 9) AS starts, round(avg(CASE WHEN regexp_matches(t, '[.?!]$') THEN 1.0::DOUBLE ELSE 0 END), 9) AS ends FROM (SELECT array_to_string(s[b + 1:e], ' ') AS t FROM (SELECT doc_id, cb AS b, ce AS e FROM r WHERE cb >= 0 UNION ALL SELECT r.doc_id, r.b, r.i FROM r JOIN s USING (doc_id) WHERE r.i = len(s.s) AND len(s.s) > 0) JOIN s USING (doc_id))")
def v09_chunks(spark, sf):
    """The same of the chunks that documents are cut into."""
    s = docs(spark, sf).select(L.sentences(c("text")).alias("s"))
    t = s.select("s", L.pack(c("s")).alias("p")).select(F.explode(L.chunk_texts(c("s"), c("p"))).alias("t"))
    share = lambda pattern: F.round(F.avg(c("t").rlike(pattern).cast("int").cast("double")), 9)
    return t.agg(share("^[A-ZÀ-ÖØ-Þ]").alias("starts"), share("[.?!]\\z").alias("ends"))


@query("n14_index_stats", "SELECT count(*) AS vectors, max(len(embedding)) AS dim, count(DISTINCT label) AS labels FROM embeddings")
def n14(spark, sf):
    return load(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).cast("long").alias("dim"), F.countDistinct("label").alias("labels"))


def by_label(spark, sf):
    return load(spark, sf, "embeddings").select(c("label").cast("long").alias("id"), c("embedding").alias("v"))


@query("p01_pooled", "WITH m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) SELECT CAST(label AS BIGINT) AS id, CAST(i - 1 AS INT) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m")
def p01(spark, sf):
    """Mean vector of each label, of length one."""
    return P.pooled(by_label(spark, sf), "id").select("id", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 6))


def neighbours(spark, sf):
    return P.nearest(vectors(spark, sf).select(c("doc_id").alias("id"), N.normalised(c("v")).alias("v")))


NN = """v AS (SELECT vec_id, list_transform(e, lambda x: x / CASE WHEN sqrt(list_dot_product(e, e)) = 0 THEN 1 ELSE sqrt(list_dot_product(e, e)) END) AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)),
nn AS (SELECT a.vec_id AS id, max(round(list_dot_product(a.v, b.v), 9)) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1)"""


@query("f09_nearest", f"WITH {NN} SELECT id, round(similarity, 6) AS similarity FROM nn")
def f09(spark, sf):
    return neighbours(spark, sf).select("id", F.round("similarity", 6).alias("similarity"))


@query("f09_pruned", f"WITH {NN} SELECT id, round(similarity, 6) AS similarity FROM nn")
def f09_pruned(spark, sf):
    """The same by pivots and bounds, whatever the number of vectors."""
    rows = vectors(spark, sf).select(c("doc_id").alias("id"), N.normalised(c("v")).alias("v"))
    return P.nearest(rows, direct=0).select("id", F.round("similarity", 6).alias("similarity"))


@query("k13_embedding_near_dup", f"WITH {NN} SELECT id, similarity >= (SELECT quantile_cont(similarity, 0.95) FROM nn) AS is_near_dup FROM nn")
def k13(spark, sf):
    return P.near_duplicates(neighbours(spark, sf)).select("id", "is_near_dup")


NEIGHBOUR = """v AS (SELECT vec_id, list_transform(e, lambda x: x / CASE WHEN sqrt(list_dot_product(e, e)) = 0 THEN 1 ELSE sqrt(list_dot_product(e, e)) END) AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)),
nb AS (SELECT * FROM (SELECT a.vec_id AS id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 9) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id) WHERE r = 1)"""


@query("g07_top_pairs", f"WITH {NEIGHBOUR} SELECT a, b, round(s, 6) AS similarity FROM (SELECT least(id, other) AS a, greatest(id, other) AS b, max(similarity) AS s FROM nb GROUP BY ALL ORDER BY s DESC, a, b LIMIT 25)")
def g07(spark, sf):
    return P.top_pairs(neighbours(spark, sf)).withColumn("similarity", F.round("similarity", 6))


@query("e39_cluster_near_dups", f"WITH {NN}, cut AS (SELECT quantile_cont(similarity, 0.95) AS c FROM nn) SELECT label, count(*) AS n, round(count_if(similarity >= c) / count(*) * 100, 1) AS percent FROM nn JOIN embeddings e ON e.vec_id = nn.id, cut GROUP BY 1")
def e39(spark, sf):
    """Near-duplicates by cluster; here the label is the cluster."""
    flagged = P.near_duplicates(neighbours(spark, sf)).join(load(spark, sf, "embeddings").select(c("vec_id").alias("id"), "label"), "id")
    return flagged.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if("is_near_dup") / F.count(F.lit(1)) * 100, 1).alias("percent"))


@query("p02_clusters")
def p02(spark, sf):
    return P.clustered(vectors(spark, sf).select(c("doc_id").alias("id"), N.normalised(c("v")).alias("v")), range(6, 15))


@query("p03_labels", "SELECT source AS cluster, string_agg(upper(substring(w, 1, 1)) || substring(w, 2), ' / ' ORDER BY n DESC, w) AS label FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS r FROM (SELECT source, w, count(*) AS n FROM (SELECT source, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS w FROM documents) WHERE length(w) > 3 AND w NOT IN ('the','and','for','with','that','this','are','was','from') GROUP BY ALL)) WHERE r <= 2 GROUP BY 1")
def p03(spark, sf):
    return P.labels(docs(spark, sf).select(c("source").alias("cluster"), c("text").alias("title")), STOP)


@query("p05_projection")
def p05(spark, sf):
    return P.projected(vectors(spark, sf).select(c("doc_id").alias("id"), N.normalised(c("v")).alias("v")))


UNIT = """v AS (SELECT vec_id, list_transform(e, lambda x: x / CASE WHEN sqrt(list_dot_product(e, e)) = 0 THEN 1 ELSE sqrt(list_dot_product(e, e)) END) AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))"""


@query("p05_graph", f"WITH {UNIT} SELECT id, other, round(s, 6) AS similarity FROM (SELECT a.vec_id AS id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 9) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id) WHERE r <= 15")
def p05_graph(spark, sf):
    """Fifteen nearest neighbours of each vector, which the map is laid out by. Exact up to a cell's rows."""
    rows = vectors(spark, sf).select(c("doc_id").alias("id"), N.normalised(c("v")).alias("v"))
    return layout.graph(rows).select("id", "other", F.round("similarity", 6).alias("similarity"))


@query("p05_layout")
def p05_layout(spark, sf):
    """The map by the neighbour graph; the tests hold it against plain linear algebra."""
    return layout.laid_out(vectors(spark, sf).select(c("doc_id").alias("id"), N.normalised(c("v")).alias("v")))


@query("i11_recency", "SELECT o_orderkey AS id, round(o_totalprice * exp(-0.01 * greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01'), 0)), 6) AS score FROM orders")
def i11(spark, sf):
    return load(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.round(N.recency(c("o_totalprice"), F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date"), 0.01), 6).alias("score"))


@query("i12_normalised", "SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM (SELECT vec_id, list_transform(e, lambda x: x / CASE WHEN sqrt(list_dot_product(e, e)) = 0 THEN 1 ELSE sqrt(list_dot_product(e, e)) END) AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))")
def i12(spark, sf):
    v = N.normalised(c("embedding"))
    return load(spark, sf, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))
