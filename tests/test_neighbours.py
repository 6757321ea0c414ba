"""Exact nearest neighbours with and without bounds."""

import random

import numpy as np
import pytest

from lexforge.operators import corpus_map


def plain(rows):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows])
    order = np.argsort(ids, kind="stable")
    s = np.round(v @ v[order].T, 9)
    s[ids[:, None] == ids[order][None, :]] = -np.inf
    best = s.argmax(axis=1)
    return {int(i): (int(ids[order][b]), float(s[n, b])) for n, (i, b) in enumerate(zip(ids, best)) if np.isfinite(s[n, b])}


def clustered(groups, each, seed, spread, dims=8):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(groups, dims))
    v = np.repeat(centers, each, axis=0) + r.normal(size=(groups * each, dims)) * spread
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = r.permutation(groups * each)
    return [(int(i), x.tolist()) for i, x in zip(ids, v)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(3)


def test_clustered_vectors_skip_most_blocks(spark, monkeypatch):
    monkeypatch.setattr(corpus_map, "BLOCK", 50)
    rows = clustered(30, 40, 1, 0.02)
    found = corpus_map.Neighbours(frame(spark, rows), block=50)
    pairs, of, sent, all_sent = found.met()
    print(f"block pairs {pairs} of {of}, vectors sent {sent} of {all_sent}")
    assert sent < 0.35 * all_sent
    got = {r["id"]: (r["other"], r["similarity"]) for r in found.found().collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("block", [3, 25, 1000])
def test_copies_zeros_and_no_structure(spark, block):
    """A vector that a third of the rows share, zero vectors, ties, and vectors that no bound tells apart."""
    r = random.Random(block)
    rows = clustered(90, 1, 2, 1.0)
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [(2000 + i, [0.0] * 8) for i in range(3)] + [(3000, [1.0] + [0.0] * 7), (3001, [-1.0] + [0.0] * 7), (3002, [0.0, 1.0] + [0.0] * 6)]
    r.shuffle(rows)
    got = {x["id"]: (x["other"], x["similarity"]) for x in corpus_map.Neighbours(frame(spark, rows), block=block).found().collect()}
    assert got == plain(rows) == {x["id"]: (x["other"], x["similarity"]) for x in corpus_map.nearest(frame(spark, rows)).collect()}


def test_few_rows(spark):
    one = [(1, [1.0, 0.0])]
    for rows in (one[:0], one, [*one, (2, [1.0, 0.0])]):
        got = {x["id"]: (x["other"], x["similarity"]) for x in corpus_map.Neighbours(spark.createDataFrame(rows, "id long, v array<double>")).found().collect()}
        assert got == ({1: (2, 1.0), 2: (1, 1.0)} if len(rows) == 2 else {})
