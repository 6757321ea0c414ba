"""Queries that are met in passes: blocks of them are broadcast, rows stay where they are."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.operators import embedding, retrieval


def plan(df):
    return df._jdf.queryExecution().toString()


def overlap(docs, queries, k):
    """As the docstring of keyword_overlap says."""
    found = []
    for qid, query in queries:
        if query is None:
            continue
        ws = {w for w in re.split("[ \t\n\x0b\f\r]+", query.lower()) if len(w) > 2 and w not in retrieval.STOPWORDS}
        scored = []
        for name, content in docs:
            hay = " ".join(x for x in (name, content) if x is not None).lower()
            score = sum(w in hay for w in ws) + 1000 * (name is not None and name.lower() in ws)
            if score:
                scored.append((-score, name is not None, name or "", score))
        found += [(qid, n if known else None, score) for _, known, n, score in sorted(scored)[:k]]
    return sorted(found, key=repr)


@pytest.mark.parametrize("few,cells", [(5000, 1 << 21), (3, 40)])
def test_keywords_are_found_without_a_pair_of_every_text_and_query(spark, monkeypatch, few, cells):
    """Few scores at once, several blocks of queries; pieces that hold several words, names that are asked for, odd white space."""
    monkeypatch.setattr(retrieval, "FEW", few)
    monkeypatch.setattr(retrieval, "CELLS", cells)
    r = random.Random(few)
    parts = ["bank", "ban", "ank", "über", "ÜBER", "the", "corpus", "x", "abcabc", "bca", "no break", "break", "日本語", "日本語の文", "d7", "D12", "long" * 40]
    text = lambda n: r.choice([" ", "\n", "  ", "\t"]).join(r.choice(parts) + r.choice(["", r.choice(parts)]) for _ in range(n))
    docs = [(f"{r.choice('dD')}{i}", text(r.randrange(12))) for i in range(60)] + [("d90", None), (None, "bank"), ("bank", ""), ("ab cabc", "über")]
    queries = [(i, text(r.randrange(9))) for i in range(14)] + [(20, None), (21, ""), (22, "the of"), (23, "d7 d12 bank")]
    found = retrieval.keyword_overlap(spark.createDataFrame(docs, "name string, content string").repartition(3), spark.createDataFrame(queries, "qid long, query string"), retrieval.STOPWORDS, 3)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert sorted([(x["qid"], x["name"], x["score"]) for x in found.collect()], key=repr) == overlap(docs, queries, 3)


def crossed(vectors, queries, k):
    """Every vector with every query, in expressions."""
    q = queries.select("qid", retrieval.normalised(F.col("v")).alias("q"))
    scored = vectors.select("doc_id", retrieval.normalised(F.col("v")).alias("v")).crossJoin(q)
    return retrieval.ranked(scored.select("qid", "doc_id", F.round(retrieval.dot(F.col("v"), F.col("q")), 9).alias("score")), k)


@pytest.mark.parametrize("cells,size,k", [(1 << 21, 16 << 20, 5), (64, 400, 1), (64, 400, 7), (200, 16 << 20, 200)])
def test_nearest_of_queries_in_blocks(spark, monkeypatch, cells, size, k):
    """Few cells at once, several blocks of queries, ties, zeros, copies, vectors that are null, hold a null or NaN, or are of
    another length or none."""
    monkeypatch.setattr(retrieval, "CELLS", cells)
    monkeypatch.setattr(retrieval, "PASS_BYTES", size)
    r = np.random.default_rng(k)
    rows = [(i, r.integers(-2, 3, 4).astype(float).tolist()) for i in range(90)] + [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [1.0, 2.0]), (103, []), (104, [float("nan"), 0.0, 0.0, 1.0]), (105, [float("inf"), 0.0, 0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "doc_id long, v array<double>").repartition(3)
    queries = vectors.where("doc_id % 5 = 0 or doc_id > 99").withColumnRenamed("doc_id", "qid")
    found = retrieval.cosine(vectors, queries, k)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    key = lambda df: sorted((repr((x["qid"], x["doc_id"], None if x["score"] is None else round(x["score"], 8) + 0.0, x["rank"])) for x in df.collect()))
    assert key(found) == key(crossed(vectors, queries, k))


def test_vectors_of_texts_shuffle_nothing(spark):
    """Repeated words, texts without words, null; held against the expression for short texts."""
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i))) for i in range(30)] + [(50, ""), (51, None), (52, "Über ÜBER 日本語 a_b")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3).localCheckpoint()
    found = embedding.embedded(df, "id", "text")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {x["id"]: x["v"] for x in found.collect()}
    want = {x["id"]: x["v"] for x in df.select("id", embedding.of_text(F.col("text")).alias("v")).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)
