"""Cases that were once wrong: clashing names, samples of repeated rows, the first polynomial alone, wide differences."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import labelled, mixing, similar, simhash, stages, suffix
from lexforge.plans.tables import materialize


def test_a_column_of_the_stage_s_own_name_is_kept(spark):
    rows = [(1, "a b c d e f g h", "keep me", "x"), (2, "other words of no use to anyone", "and me", "y"), (3, "a b c d e f g h", "not me", "z")]
    for name in ("_row_key", "_ROW_KEY"):
        df = spark.createDataFrame(rows, f"doc_id long, text string, {name} string, _row_key_ string")
        found = sorted(tuple(r) for r in stages.drop_near_duplicates(spark, df, "").collect())
        assert found == [rows[0], rows[1]]


def test_copies_are_one_in_the_sample_of_the_weights(spark, monkeypatch):
    """300 texts and 20,000 copies of one, ids that many texts share: few are fitted on, all are counted."""
    seen = []
    monkeypatch.setattr(mixing.Model, "fit", lambda self, x, hashes, fit=mixing.Model.fit: seen.append(len(x)) or fit(self, x, hashes))
    r = random.Random(2)
    some = [(i, " ".join(r.choices(["a", "b", "c", "dd"], k=9))) for i in range(300)] + [(7, f"text number {i} of one id") for i in range(300)]
    df = spark.createDataFrame(some, "doc_id long, text string").unionAll(spark.range(20_000).select(F.lit(3).cast("long"), F.lit("the same text again")))
    counts = mixing.count_tokens(df)
    for rows in (20, 4000, 10**6):
        monkeypatch.setattr(mixing, "SAMPLE_ROWS", rows)
        model = mixing.train(df, counts)
        assert model.tokens == 300 * 10 + 300 * 7 + 20_000 * 5
    assert max(seen) <= 10 * 601
    assert seen[0] < 2000  # a fifth of the distinct rows


def test_one_id_with_many_texts_does_not_fill_the_sample(spark):
    docs = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = docs.unionAll(spark.range(2, 60).select("id", F.concat(F.lit("own "), F.col("id")))).unionAll(spark.range(3000).select(F.lit(2).cast("long"), F.lit("copy")))
    labels = spark.range(1, 60).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    found = labelled.sample(docs, labels, "toxic", F.lit(True), 300, "doc_id", "text")
    assert 150 < found.count() < 500
    assert labelled.sample(docs.where("doc_id > 2"), labels, "toxic", F.lit(True), 300, "doc_id", "text").count() == 57


def test_surroundings_do_not_hang_on_the_first_polynomial(monkeypatch):
    """With a first polynomial that sees nothing, surroundings are still told apart."""
    whole = suffix._tables
    monkeypatch.setattr(suffix, "_tables", lambda n, name=0: whole(n, name) if name else (np.ones(256, np.uint64), np.ones(n, np.uint64), np.ones(n, np.uint64)))
    r = random.Random(9)
    texts = [bytes(r.choices(b"abcd", k=200)) for _ in range(40)]
    block = suffix.Block(b"".join(texts), np.full(40, 200), 200)
    _, left, right, _, around = block.anchors()
    by = {}
    for a, b, h in zip(left.tolist(), right.tolist(), around.tolist()):
        by.setdefault(h, set()).add(bytes(block.bytes[a:b]))
    assert len(by) >= 40 and all(len(x) == 1 for x in by.values())


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.mark.parametrize("wide", [2, 6])
def test_many_share_a_difference(spark, monkeypatch, wide):
    """Two families of texts that are alike below the similarity, with copies near enough in each: more levels than one."""
    monkeypatch.setattr(similar, "WIDE", wide)
    r = random.Random(wide)
    texts = []
    for family in range(2):
        base = [f"{family}w{i}" for i in range(100)]
        for branch in range(6):
            own = base[:]
            own[40:52] = [f"{family}b{branch}x{i}" for i in range(12)]
            for _ in range(7):
                words = own[:]
                at = r.randrange(100)
                words[at] = f"n{r.randrange(10**6)}"
                texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {x["doc_id"]: x["component_id"] for x in similar.similar_texts(df, hot=2).collect()} == {i: find(i) for i in range(len(texts))}


def test_near_fingerprints_are_links_without_a_shared_key(spark):
    """The operator's multi-index hashing gives pairs of its own; each is verified on the whole sets."""
    r = random.Random(11)
    texts = []
    for _ in range(12):
        words = [f"w{r.randrange(5000)}" for _ in range(600)]
        texts += [" ".join(words), " ".join([*words, "more"])]
    fps = [simhash.fingerprint(t.encode().split(), 3) for t in texts]
    near = {(i, i + 1) for i in range(0, 24, 2) if (fps[i] ^ fps[i + 1]).bit_count() <= 2}
    assert len(near) >= 6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = materialize(similar.prints(df, ["doc_id"])).select(F.col("carried.doc_id").alias("fid"), "fp", "size", F.array(F.col("row")).alias("keys"), "shingles", "sketch")
    assert {(x["src"], x["dst"]) for x in similar.similar_links(rows).collect()} == near
    alike = rows.withColumn("fp", F.lit(7).cast("long"))  # one fingerprint of unlike texts: the first is compared with the others
    assert {(x["src"], x["dst"]) for x in similar.similar_links(alike).collect()} == {(0, 1)}


def test_a_text_s_differences_are_looked_at_once(spark, monkeypatch):
    """Keys of members that are alike have one leader, so that a text is not told apart from each of many."""
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(3000)]
    base, texts = r.choices(words, k=300), []
    for _ in range(150):
        t = list(base)
        for at in r.sample(range(5, 295, 10), 5):
            t[at] = r.choice(words)
        texts.append(" ".join(t))
    seen = []

    def watched(df):
        found = materialize(df)
        if "apart" in found.columns:
            seen.append((found.count(), found.select("family").distinct().count()))
        return found

    monkeypatch.setattr(similar, "materialize", watched)
    similar.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot=4).count()
    rows, families = seen[0]
    assert rows <= 1.3 * len(texts) and families <= 12
