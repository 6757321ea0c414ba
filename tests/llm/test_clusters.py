"""Operator 11 against plain Lloyd rounds in Python integers."""

import hashlib
import math
import random

import pytest

from lexforge.llm import clusters, queries


def plain(rows, k, rounds, dims, scale=1024):
    """(vec_id, cluster, distance) of every sound row, and the centroids."""
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, centroids)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centroids


def check(df, rows, k, rounds, dims):
    wanted, centroids = plain(rows, k, rounds, dims)
    found = clusters.clustered(df, k, rounds, dims).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found), key=key) == sorted(wanted, key=key)
    for r in found:
        assert r.cluster_inertia == sum(d for _, c, d in wanted if c == r.cluster)
        assert r.inertia == sum(d for _, _, d in wanted)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_given_vectors(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    wanted, _ = plain(rows, 8, 10, 64)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in queries.op11_clusters(spark, data).collect()) == sorted(wanted)


@pytest.mark.parametrize("seed", range(3))
def test_ties_copies_and_empty_clusters(spark, monkeypatch, seed):
    """Few places on a grid: many ties, equal seeds, clusters that lose all; blocks of a few vectors."""
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 7)
    r = random.Random(seed)
    rows = [(r.choice([i, i, 3]), [r.choice([0.0, 0.5, 1.0, -0.25]) for _ in range(3)]) for i in range(90)] + [(1000 + i, [0.5, 0.5, 0.0]) for i in range(60)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), rows, 6, 5, 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, []), (None, [0.5, -0.5]), (1, [1.0, 2.0]), (8, [-3.0, 4.0]), (9, [1e4, -1e4])]
    schema = "vec_id long, embedding array<float>, cluster string, distance string, ids int"
    df = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], schema)
    check(df, rows, 3, 4, 2)
    check(df, rows, 50, 2, 2)
    assert clusters.clustered(df.limit(0), 8, 10, 2).collect() == []
    assert clusters.clustered(df.where("vec_id in (2, 3, 4)"), 8, 10, 2).collect() == []
    with pytest.raises(Exception, match="do not fit into 64 bits"):
        clusters.clustered(spark.createDataFrame([(1, [1e15])], "vec_id long, embedding array<double>"), 1, 1, 1).collect()


def test_heaps_spare_vectors(spark):
    """In groups that lie apart, later rounds look at few vectors again."""
    r = random.Random(5)
    rows = [(i, [r.gauss(10 * (i % 4), 0.2), r.gauss(-7 * (i % 4), 0.2)]) for i in range(2000)]
    found = clusters.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), 4, 10, 2)
    assert found.rescanned[0] == 2000 and sum(found.rescanned[6:]) < 2000
