"""Core operators against plain Python on small inputs."""

import os
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexforge import registry
from lexforge.functions import gates, parsing, web
from lexforge.operators import aggregates, chunking, dedup, graph, merging, ranking, retrieval
from lexforge.sources import files, views


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == components({x for e in edges for x in e}, edges)


def test_rank_in_groups(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(1000)] + [(0, 5)] * 20, "g int, k long")
    by = {}
    for r in ranking.rank_in_groups(df, "g", F.col("k"), salts=7).collect():
        by.setdefault(r["g"], []).append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_greedy_leaders(spark):
    random.seed(2)
    rows = [(i, random.sample("abcdefghij", random.randint(0, 5))) for i in range(150)]
    got = {r["ord"]: r["keep"] for r in dedup.leaders(spark.createDataFrame(rows, "ord long, tokens array<string>"), 0.6).collect()}
    kept, wanted = [], {}
    for o, t in rows:
        s = set(t)
        wanted[o] = not s or not any(x and len(s & x) / len(s | x) >= 0.6 for x in kept)
        if wanted[o]:
            kept.append(s)
    assert got == wanted


def test_banded_pairs(spark):
    random.seed(6)
    base = [random.getrandbits(64) for _ in range(20)]
    prints = {b ^ sum(1 << random.randrange(64) for _ in range(random.randint(0, 4))) & (1 << 64) - 1 for b in base for _ in range(8)}
    signed = sorted(p - (1 << 64) if p >= 1 << 63 else p for p in prints)
    got = {(r["a"], r["b"]) for r in dedup.banded_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), 5).collect()}
    assert got == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 5}


def packed(sentences, most, overlap):
    out, begin, size = [], 0, 0
    for i, s in enumerate(sentences):
        if size + len(s) > most and i > begin:
            out.append((begin, i))
            begin = max(i - overlap, begin) if overlap else i
            size = sum(map(len, sentences[begin:i]))
        size += len(s)
    return out + [(begin, len(sentences))] if sentences else []


def test_sentence_packing(spark):
    random.seed(8)
    texts = [" ".join("x" * random.randint(1, 90) + random.choice(".!?") for _ in range(random.randint(0, 30))) for _ in range(60)] + ["", "no end", " . ! "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunking.sentences(F.col("t")).alias("s"))
    for overlap in (0, 1, 2):
        for r in df.select("i", "s", chunking.pack(F.col("s"), 120, overlap).alias("p")).collect():
            assert [(x["b"], x["e"]) for x in r["p"]] == packed(r["s"], 120, overlap), (overlap, texts[r["i"]])
    for r in df.collect():
        assert r["s"] == [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", texts[r["i"]])) if s]


def test_cooccurrence_keeps_multiplicity(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (2, None)], "d int, e string")
    assert [tuple(r) for r in aggregates.cooccurrence(df, "e", "d", 9).collect()] == [("a", "b", 7)]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from("pqrs"), st.sampled_from(["dense", "bm25"])), max_size=12))
def test_rank_fusion(spark, hits):
    rows = [(q, k, s, i, float(i)) for i, (q, k, s) in enumerate(hits)]
    got = {(r["qid"], r["key"]): r["rrf"] for r in retrieval.fused(spark.createDataFrame(rows, "qid int, key string, source string, rank int, score double")).collect()}
    wanted = {}
    for q, k, _, i, _ in rows:
        wanted[q, k] = wanted.get((q, k), 0) + 1 / (60 + i + 1)
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in wanted.items()}


def test_upsert_is_idempotent(spark):
    stored = spark.createDataFrame([(1, "a", "2024-01-01", "done"), (2, "b", "2024-01-02", "done")], "id int, h string, at string, v string")
    new = spark.createDataFrame([(2, "c", "2024-01-03", "x"), (3, "d", "2024-01-01", "x"), (1, "a", "2023-01-01", "x"), (3, "d0", "2023-01-01", "x")], stored.schema)
    once = merging.upsert(stored, new, "id", "h", "at", on_change={"v": F.lit("pending")})
    assert {(r["id"], r["h"], r["v"], r["action"]) for r in once.collect()} == {(1, "a", "done", "skipped"), (2, "c", "pending", "updated"), (3, "d", "x", "inserted")}
    again = merging.upsert(once.drop("action"), new, "id", "h", "at", on_change={"v": F.lit("pending")})
    assert {r["action"] for r in again.collect()} == {"skipped"}
    assert {tuple(r) for r in again.drop("action").collect()} == {tuple(r) for r in once.drop("action").collect()}


def test_urls(spark):
    urls = {
        " HTTP://WWW.Host.Org:80/A//?utm_source=x&b=2&a=&c=3&b=1&REF=9#top": "http://host.org:80/A?b=2&b=1&c=3",
        "https://m.host.org/p;v=1/": "https://m.host.org/p;v=1",
        "https://host.org/a;x?q=a%20b": "https://host.org/a?q=a+b",
        "": "",
        "http://[bad/": "http://[bad",
    }
    df = spark.createDataFrame([(u,) for u in [*urls, None]], "u string").select("u", web.normalize_url("u").alias("n"))
    assert {r["u"]: r["n"] for r in df.collect()} == urls | {None: ""}


def test_article():
    body = "word " * 30
    page = f"<html><head><title>A &amp; B</title><script>var x='<p>';</script></head><body><nav>menu</nav><article><h1>A</h1><p>{body}<br>end</article><div class='ad-banner'>buy</div><footer>f</footer></body></html>"
    title, text = web.article(page)
    assert title == "A & B" and "buy" not in text and "menu" not in text and text.endswith("end") and text.startswith("A")
    assert web.article("<p>short</p>")[1] == "" and web.article(None) == ("", "")


def test_gates_on_odd_texts(spark):
    texts = ["", None, " \n\t ", "!" * 300, "x" * 199, "x" * 200, "word " * 200, "PAGE ONE\n" * 60, "12\n34\n" * 100, "é" * 600]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: (r["a"], r["b"]) for r in df.select("i", gates.statistical(F.col("t"), F.lit("en"), ["word"]).alias("a"), gates.rule_based(F.col("t")).alias("b")).collect()}
    assert [got[i][0] for i in range(10)] == ["length", "length", "length", "domain_relevance", "length", "domain_relevance", "token_diversity", "token_diversity", "token_diversity", "domain_relevance"]
    assert [got[i][1] for i in range(10)] == ["empty", "empty", "empty", "too_short", "too_short", "too_short", "low_diversity", "low_diversity", None, "garbage"]


def test_pages_lose_rows_on_equal_stamps_unless_the_cursor_is_a_pair(spark):
    df = spark.createDataFrame([(i, i // 4) for i in range(12)], "id int, ts int")
    first = {r["id"] for r in merging.page_after(df, "ts", F.lit(0), 3).collect()}
    assert len(first) == 3 and first < {4, 5, 6, 7}
    rest = {r["id"] for r in merging.page_after(df, "ts", F.lit(1), 12).collect()}
    assert rest == {8, 9, 10, 11}  # one of the four is on no page
    assert [r["id"] for r in merging.page_after(df, "ts", F.lit(1), 3, "id", F.lit(5)).collect()] == [6, 7, 8]


def test_text_files_and_sidecars(spark, tmp_path):
    from lexforge.sources import files

    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "a_metadata.json").write_text('{"title": "A"}')
    texts = files.text_files(spark, str(tmp_path), "*.txt")
    assert {(r["stem"], r["text"]) for r in texts.collect()} == {("a", "é"), ("b", "é")}
    sidecars = spark.createDataFrame([(f"{tmp_path}/a_metadata.json", "A")], "path string, title string")
    assert {(r["stem"], r["title"]) for r in files.with_sidecars(texts, sidecars).collect()} == {("a", "A"), ("b", None)}
    assert {(r["catalog"], r["title"]) for r in files.json_catalog(spark, f"{tmp_path}/*.json", "title string").collect()} == {("a_metadata", "A")}


def test_signals_of_all_documents_are_deduplicated(spark, data):
    """K12 against the greedy loop, over every row of the table."""
    rows = views.view(spark, data, "signals").select("id", "source_content_id", "signal_type", "confidence", "entity", dedup.tokens(F.col("entity")).alias("t")).collect()
    kept, wanted = {}, Counter()
    for r in sorted(rows, key=lambda r: (-round(r["confidence"] * 1000), r["id"], r["source_content_id"], r["signal_type"], r["entity"])):
        before, own = kept.setdefault((r["source_content_id"], r["signal_type"]), []), set(r["t"])
        if not any(own and x and len(own & x) / len(own | x) >= 0.8 for x in before):
            before.append(own)
            wanted[r["id"]] += 1
    assert Counter(r["id"] for r in registry.QUERIES["k12_signal_fuzzy_dedup"](spark, data).collect()) == wanted
    assert {r["source_content_id"] % 4 for r in rows if r["id"] in wanted} == {0, 1, 2, 3}


def test_merges_by_key(spark):
    stored = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", None)], "id long, v string, mark string")
    incoming = spark.createDataFrame([(2, "B"), (4, "D")], "id long, v string")
    got = {r["id"]: (r["v"], r["mark"], r["action"]) for r in merging.merge_by_key(stored, incoming, "id").collect()}
    assert got == {1: ("a", "x", "kept"), 2: ("B", "y", "updated"), 3: ("c", None, "kept"), 4: ("D", None, "inserted")}
    kept = {r["id"]: r["v"] for r in merging.merge_by_key(stored, incoming, "id", keep=["v"]).collect()}
    assert kept == {1: "a", 2: "b", 3: "c", 4: "D"}
    changes = spark.createDataFrame([(1, "new\u0000", None), (3, None, "m"), (9, "no", "no")], "id long, v string, mark string")
    updated = {r["id"]: (r["v"], r["mark"], r["at"]) for r in merging.update_by_key(stored.withColumn("at", F.lit("old")), changes, "id", F.lit("now"), stamp="at").collect()}
    assert updated == {1: ("new", "x", "now"), 2: ("b", "y", "old"), 3: ("c", "m", "now")}


def test_inserted_rows_get_the_next_ids(spark):
    stored = spark.createDataFrame([(7, "p"), (3, "q")], "id long, path string")
    incoming = spark.createDataFrame([("p", "t"), ("r", "t\u0000"), ("s", "t"), ("s", "u")], "path string, text string")
    got = sorted((r["id"], r["path"], r["text"]) for r in merging.inserted(stored, incoming, "path", texts=["text"]).collect())
    assert [i for i, _, _ in got] == [8, 9] and {(p, t) for _, p, t in got} == {("r", "t"), ("s", "t")}
    assert sorted(r["id"] for r in merging.inserted(stored.limit(0), incoming, "path").collect()) == [1, 2, 3]


def test_near_fingerprints_at_any_distance(spark):
    r = random.Random(11)
    base = [r.getrandbits(64) for _ in range(5)]
    prints = sorted({b ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 7))}) for b in base for _ in range(40)})
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for distance in (0, 1, 2, 3, 5):
        got = {(x["a"], x["b"], x["distance"]) for x in dedup.banded_pairs(df, distance).collect()}
        wanted = {(min(a, b), max(a, b), d) for i, a in enumerate(signed) for b in signed[:i] if (d := ((a ^ b) & ((1 << 64) - 1)).bit_count()) <= distance}
        assert got == wanted


def test_registry_of_earlier_rows(spark):
    rows = [(1, 0b1111, True), (2, 0b1110, True), (3, 0b10, False), (4, 0, True), (5, 0, True), (6, 0b111 << 40, True), (7, 0b1 << 40, True), (8, 0b10, True)]
    got = sorted(r["id"] for r in dedup.near_earlier(spark.createDataFrame(rows, "id long, fp long, registers boolean"), 2).collect())
    wanted = [i for i, f, _ in rows if f and any(g and reg and j < i and (f ^ g).bit_count() <= 2 for j, g, reg in rows)]
    assert got == wanted


def greedy(rows, threshold):
    stay = []
    for o, tokens in sorted(rows):
        s = set(tokens)
        if not s or not any(k and len(s & k) / len(s | k) >= threshold for _, k in stay):
            stay.append((o, s))
    return {o for o, _ in stay}


def test_greedy_order_of_chains_and_equal_rows(spark):
    r = random.Random(12)
    rows = []
    for o in range(300):
        start = r.randrange(60)
        rows.append((o, [f"w{i}" for i in range(start, start + 12)] if o % 7 else []))
    got = {x["ord"] for x in dedup.leaders(spark.createDataFrame(rows, "ord long, tokens array<string>"), 0.7).where("keep").collect()}
    assert got == greedy(rows, 0.7)


def test_word_segments(spark):
    from lexforge.operators import chunking

    r = random.Random(13)
    texts = [" ".join("x" * r.randint(1, 30) for _ in range(r.randint(0, 400))) for _ in range(30)] + ["", "  \n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    for row in df.select("id", chunking.word_segments(F.col("t"), 100).alias("n")).collect():
        wanted, size, n = [], 0, 0
        for w in texts[row["id"]].split():
            size, n = size + len(w) + 1, n + 1
            if size >= 100:
                wanted.append(n)
                size = n = 0
        assert row["n"] == wanted + ([n] if n else [])


def test_urls_of_every_kind(spark):
    from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

    def plain(url):
        u = urlsplit((url or "").strip())
        head, slash, last = u.path.rpartition("/")
        pairs = sorted(((k, v) for k, v in parse_qsl(u.query) if k.lower() not in web.TRACKING), key=lambda p: p[0])
        return urlunsplit((u.scheme.lower(), u.netloc.lower().removeprefix("www."), (head + slash + last.split(";", 1)[0]).rstrip("/"), urlencode(pairs), ""))

    urls = [
        "HTTP://WWW.Example.com:80/a/b/?b=2&a=1&utm_source=x#top", "https://h/p;x=1/q;y=2?z=%20a+b&z=1&e=", "https://h/?q=a*b~c%2Fd&ref=1", "//h/p/", "mailto:a@b.c",
        "no url at all", "", None, "https://h?x=%zz", "https://user:pw@WWW.h/ü?ä=ö&UTM_TERM=1", "http://h/a//", "http://h/p?flag&x=1",
    ]
    got = [r["u"] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(web.normalize_url("url").alias("u")).collect()]
    assert got == [plain(u) for u in urls]


def test_recovered_json(spark):
    raws = ['{"a": 1}', '```json\n{"a": 2}\n```', 'so {"a": 3, "b": {"c": {}}} and {x}', "none", "", None, '{"a": 5']
    df = spark.createDataFrame([(r,) for r in raws], "r string")
    got = [x["a"] for x in df.select(F.try_variant_get(parsing.recovered_json(F.col("r")), "$.a", "int").alias("a")).collect()]
    assert got[:3] == [1, 2, 3] and got[3:] == [None] * 4


def test_files_that_wait(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", ".c.pdf", "d.zip", "e.txt"):
        (tmp_path / name).write_bytes(b"x")
    states = spark.createDataFrame([(f"{tmp_path}/b_metadata.json", "processed"), (f"{tmp_path}/e_metadata.json", "downloaded")], "path string, status string")
    assert sorted(r["stem"] for r in files.pending_files(spark, str(tmp_path), (".pdf", ".txt"), states).collect()) == ["a", "e"]
    (tmp_path / "f.st").write_bytes(b"ok \xff end")
    assert [(r["name"], r["text"]) for r in files.code_files(spark, str(tmp_path)).collect()] == [("f.st", "ok � end")]


def test_scratch_tables_go_and_results_stay(spark):
    from lexforge.plans import tables

    with tables.scratch(spark) as keep:
        inner = tables.materialize(spark.range(5))
        result = keep(inner.withColumn("x", F.col("id") * 2))
        gone = inner.inputFiles()[0].removeprefix("file:")
    assert result.agg(F.sum("x")).first()[0] == 20
    assert not os.path.exists(gone) and not tables._OPEN
