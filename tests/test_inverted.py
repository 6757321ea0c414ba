"""The written index against BM25 over the corpus."""

import random

from pyspark.sql import functions as F

from lexforge.operators import inverted, retrieval


def test_index_gives_what_the_corpus_gives(spark, tmp_path, monkeypatch):
    """A term that all documents have, rare ones, repeated and unknown terms; blocks of a few postings; a second query set."""
    monkeypatch.setattr(inverted, "BLOCK", 8)
    r = random.Random(3)
    rows = [(i, "the " + " ".join(f"w{int(r.paretovariate(0.7)) % 400}" for _ in range(r.randint(0, 60)))) for i in range(400)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = inverted.Index(spark, str(tmp_path / "index")).build(docs)
    for asked in ([(1, "the w1 w7"), (2, "w300 w300 w17"), (3, "nothing there"), (4, "")], [(9, "w2 w3 w5 w8 w13 w21 w34"), (10, "w399")]):
        queries = spark.createDataFrame(asked, "qid long, query string")
        wanted = {tuple(x) for x in retrieval.bm25(docs, queries, 5).select("qid", "doc_id", "rank", F.round("score", 7)).collect()}
        assert {tuple(x) for x in index.search(queries, 5).select("qid", "doc_id", "rank", F.round("score", 7)).collect()} == wanted
    sizes = index._read("blocks").select(F.size("posts").alias("n")).agg(F.max("n")).first()[0]
    assert sizes < 40


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    """Of a frequent term only blocks of high impact are read beside a rare one."""
    monkeypatch.setattr(inverted, "BLOCK", 4)
    r = random.Random(4)
    rows = [(i, " ".join(["common"] * r.choice([1, 1, 1, 2, 9]) + [f"x{r.randrange(5000)}" for _ in range(r.randint(5, 80))] + (["rare"] * 3 if i % 200 == 0 else []))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = inverted.Index(spark, str(tmp_path / "index")).build(docs)
    queries = spark.createDataFrame([(1, "common rare")], "qid long, query string")
    wanted = [tuple(x) for x in retrieval.bm25(docs, queries, 3).orderBy("rank").select("doc_id", "rank").collect()]
    assert [tuple(x) for x in index.search(queries, 3).orderBy("rank").select("doc_id", "rank").collect()] == wanted
    read, there = index.read
    assert read < there / 2, index.read


def test_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    index = inverted.Index(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "a")], "qid long, query string")
    assert index.build(docs).search(queries, 3).count() == 0
