"""Language profiles, learned sentence boundaries and the default embedder against plain Python."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import regex
from pyspark.sql import functions as F

from lexforge.functions import boundaries, language
from lexforge.operators import embedding
from lexforge.plans import q_chunks, q_gates


def test_held_out_documents_have_their_language(spark, data):
    found = q_gates.j04(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.length("text").alias("n")), "doc_id").where("held_out AND n > 200").collect()
    assert len(found) > 20
    assert sum(r["lang"] == r["found"] for r in found) >= 0.97 * len(found)


def test_profiles_are_plain_counts(spark):
    rows = [("aa", "the cat the dog", 1), ("aa", "The-Dog 12 the", 2), ("bb", "le chat le chien", 3), ("bb", None, 4), (None, "no language", 5), ("bb", "été à", 6)]
    known = language.learned(spark.createDataFrame(rows, "lang string, text string, id int"))
    assert known.names == ["aa", "bb"]

    def slots(text):
        clean = " " + regex.sub(r"[^\p{L}]+", " ", text.lower()).strip() + " "
        return [((((ord(a) * 0x9E3779B1 + ord(b)) * 0x85EBCA77 + ord(c)) * 0xC2B2AE3D27D4EB4F) % (1 << 64)) >> 48 for a, b, c in zip(clean, clean[1:], clean[2:])]

    for row, name in enumerate(known.names):
        counts = Counter(s for lang, text, _ in rows if lang == name for s in slots(text or ""))
        total = sum(counts.values()) + language.PRIOR * language.SLOTS
        wanted = np.log(np.array([counts[s] + language.PRIOR for s in range(language.SLOTS)]) / total)
        assert np.allclose(known.weights[row], wanted, atol=1e-5)
    asked = spark.createDataFrame([("the dogs",), ("le chien",), ("123",), (None,), ("",)], "t string")
    assert [r["o"] for r in asked.select(known.of(F.col("t")).alias("o")).collect()] == ["aa", "bb", None, None, None]
    assert language.learned(spark.createDataFrame([], "lang string, text string")).best("x") is None


def plain_abbreviations(texts):
    counts, dots = Counter(), Counter()
    for text in texts:
        for t in re.split(r"[ \t\n\x0b\f\r]+", text.lower()):
            if regex.search(r"^\p{L}[\p{L}.]*\.$", t):
                counts[t[:-1]] += 1
                dots[t[:-1]] += 1
            elif regex.search(r"^\p{L}([\p{L}.]*\p{L})?[,;:]?$", t):
                counts[t.rstrip(",;:")] += 1
            elif t:
                counts[None] += 1
    p = sum(dots.values()) / max(1, sum(counts.values()))
    out = {}
    for w, c in dots.items():
        n, inner = counts[w], w.count(".")
        letters = len(w) - inner + 1
        ratio = -2 * ((c * math.log(p) + (n - c) * math.log(1 - p)) - (c * math.log(0.99) + (n - c) * math.log(0.01)))
        out[w] = ratio * math.exp(-letters) * (inner + 1) * letters ** -(n - c)
    return {w for w, s in out.items() if s >= 0.3}


def plain_split(text, known):
    pieces = [s for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", text.strip(" \t\n\x0b\f\r")) if s]
    out = []
    for piece in pieces:
        last = re.split(r"[ \t\n\x0b\f\r]", out[-1])[-1].lower() if out else ""
        if out and last.endswith(".") and last[:-1] in known:
            out[-1] += " " + piece
        else:
            out.append(piece)
    return out


def test_boundaries_of_given_documents(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    known = plain_abbreviations([t or "" for t in texts.values()])
    got = {}
    for r in q_chunks.l01_learned(spark, data).orderBy("doc_id", "ord").collect():
        got.setdefault(r["doc_id"], []).append(r["digest"])
    wanted = {i: [hashlib.md5(s.encode()).hexdigest() for s in plain_split(t or "", known)] for i, t in texts.items()}
    assert got == {i: x for i, x in wanted.items() if x}


def test_abbreviations_are_learned_and_do_not_end_sentences(spark):
    texts = [f"Dr. {n} saw it. It was at {i} p.m. on a day. See fig. {i} there! The end of a day" for i, n in enumerate(["Ash", "Bo", "Cy", "Di"] * 30)]
    texts += ["The day is long. A day ends so. What a day? It was", "dr. a. b.", "", "..."]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    known = boundaries.abbreviations(rows)
    assert set(known) == plain_abbreviations(texts) and {"dr", "p.m", "fig"} <= set(known) and "day" not in known and "it" not in known
    got = [r["s"] for r in rows.select(boundaries.split(F.col("text"), known).alias("s")).collect()]
    assert got == [plain_split(t, set(known)) for t in texts]
    assert got[0] == ["Dr. Ash saw it.", "It was at 0 p.m. on a day.", "See fig. 0 there!", "The end of a day"]
    assert [r["s"] for r in rows.select(boundaries.split(F.col("text")).alias("s")).collect()] == [plain_split(t, set()) for t in texts]


def plain_vector(text, dims):
    v = [0.0] * dims
    for t, n in Counter(regex.findall(r"[\p{L}\p{N}_]+", (text or "").lower())).items():
        h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
        v[h % dims] += (1 if h // dims % 2 == 0 else -1) * (1 + math.log(n))
    norm = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / norm for x in v]


def test_texts_and_queries_have_the_same_vectors(spark):
    rows = [(1, "the cat and the dog"), (2, None), (3, ""), (4, "?!"), (5, "été ÉTÉ ete_1 cat"), (6, " ".join(f"w{i % 300}" for i in range(2000)))]
    df = spark.createDataFrame(rows, "id long, text string")
    for dims in (16, 384):
        got = {r["id"]: r["v"] for r in embedding.embedded(df, "id", "text", dims).collect()}
        assert got.keys() == dict(rows).keys()
        for i, text in rows:
            assert np.allclose(got[i], plain_vector(text, dims), atol=1e-12)
    short = df.where("id < 6").select("id", embedding.of_text(F.col("text"), 16).alias("v")).collect()
    assert all(np.allclose(r["v"], plain_vector(dict(rows)[r["id"]], 16), atol=1e-12) for r in short)
