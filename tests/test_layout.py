"""The map by the neighbour graph, against plain linear algebra."""

import numpy as np
import pytest

from lexforge.operators import corpus_map, layout
from lexforge.operators.retrieval import normalised
from tests.test_neighbours import clustered, frame


def plain_graph(rows, k):
    ids = np.array(sorted(i for i, _ in rows))
    v = np.array([dict(rows)[i] for i in ids])
    s = np.round(v @ v.T, 9)
    np.fill_diagonal(s, -np.inf)
    best = np.argsort(-s, axis=1, kind="stable")[:, : min(k, len(ids) - 1)]
    return {(int(ids[i]), int(ids[j])): float(s[i, j]) for i in range(len(ids)) for j in best[i]}


def found_graph(df):
    return {(r["id"], r["other"]): r["similarity"] for r in df.collect()}


def share_kept(near, places, k):
    ids = np.array(sorted(places))
    xy = np.array([places[i] for i in ids])
    far = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    np.fill_diagonal(far, np.inf)
    close = {(int(ids[i]), int(ids[j])) for i, row in enumerate(np.argsort(far, axis=1, kind="stable")[:, :k]) for j in row}
    return len(close & set(near)) / len(near)


def test_one_cell_is_exact(spark):
    rows = clustered(20, 10, 3, 0.3)
    assert found_graph(layout.graph(frame(spark, rows), 7)) == pytest.approx(plain_graph(rows, 7))


def test_cells_find_neighbours_of_clustered_vectors(spark):
    rows = clustered(40, 40, 4, 0.05)
    got, want = found_graph(layout.graph(frame(spark, rows), 10, block=100)), plain_graph(rows, 10)
    assert len(set(got) & set(want)) / len(want) > 0.9
    assert max(sum(1 for a, _ in got if a == i) for i, _ in rows) == 10


def test_crowded_cells_of_near_equal_vectors_end(spark):
    """A third lies so near to one point that pivots hardly part it; every row still has its neighbours."""
    rows = clustered(1, 150, 5, 1e-7) + [(1000 + i, v) for i, v in clustered(10, 30, 6, 0.2)]
    got = layout.graph(frame(spark, rows), 5, trees=2, block=30).groupBy("id").count().collect()
    assert len(got) == 450 and all(r["count"] == 5 for r in got)


def test_walk_is_the_dense_walk(spark):
    near = {(0, 1): 0.5, (1, 2): 0.25, (2, 3): 1.0, (3, 0): -0.5}
    edges = layout.undirected(spark.createDataFrame([(a, b, s) for (a, b), s in near.items()], "id long, other long, similarity double"))
    w = np.zeros((5, 5))
    for (a, b), s in near.items():
        w[a, b] = w[b, a] = max(s, layout.FAINT)
    d, x = w.sum(1), np.array([1.0, -2.0, 3.0, 0.5, 4.0])  # node 4 has no edges
    nodes = spark.createDataFrame([(i, float(d[i]), float(x[i])) for i in range(5)], "id long, d double, x0 double")
    got = {r["id"]: r["x0"] for r in layout.walk(nodes, edges, ["x0"]).collect()}
    want = (x + np.divide(w @ x, d, out=np.zeros(5), where=d > 0)) / 2
    assert [got[i] for i in range(5)] == pytest.approx(list(want))


def test_slowest_eigenvectors(spark):
    """Enough rounds from any start give what a dense solver gives, up to sign."""
    rows = clustered(5, 12, 7, 0.6)
    edges = layout.undirected(layout.graph(frame(spark, rows), 6))
    w = np.zeros((60, 60))
    for r in edges.collect():
        w[r["id"], r["other"]] = r["w"]
    d = w.sum(1)
    # the graph has two parts, so the constant is taken out of the plane of the eigenvalue 1
    values, vectors = np.linalg.eigh((w / np.sqrt(np.outer(d, d))) - np.sqrt(np.outer(d, d)) / d.sum())
    want = (vectors / np.sqrt(d)[:, None])[:, -2:]
    assert values[-2] - values[-3] > 0.01  # the plane is well defined
    r = np.random.default_rng(8)
    starts = spark.createDataFrame([(i, *map(float, r.normal(size=8))) for i in range(60)], "id long, " + ", ".join(f"x{j} double" for j in range(8)))
    places = {p["id"]: (p["x"], p["y"]) for p in layout.spectral(starts, edges, rounds=15).collect()}
    got = np.array([places[i] for i in range(60)])
    cross = got.T @ (want * d[:, None])
    assert np.abs(np.linalg.det(cross)) == pytest.approx(1, abs=1e-2)  # the same plane
    assert got.T @ (got * d[:, None]) == pytest.approx(np.eye(2), abs=1e-6)


def test_keeps_more_neighbours_than_principal_components(spark, data):
    given = spark.read.parquet(f"{data}/embeddings.parquet").selectExpr("vec_id as id", "embedding as v")
    given = given.select("id", normalised(given["v"]).alias("v"))
    near = found_graph(layout.graph(given))
    shares = [share_kept(near, {r["id"]: (r["x"], r["y"]) for r in df.collect()}, 15) for df in (layout.laid_out(given), corpus_map.projected(given))]
    print("kept by the graph, by principal components:", shares)
    assert shares[0] > 1.15 * shares[1]


def test_odd_rows(spark):
    """Nulls, other lengths, no components, copies, repeated ids, extra columns of the operator's own names."""
    rows = clustered(4, 10, 9, 0.3)
    nan, same = float("nan"), rows[0][1]
    odd = [(100, None), (101, [1.0]), (102, []), (103, [nan] * 8), (104, [None] * 8), (105, same), (105, same), (106, [0.0] * 8)]
    given = spark.createDataFrame([(i, v, 1.0, 2.0, 3) for i, v in rows + odd], "id long, v array<double>, x double, w double, node int")
    got = layout.laid_out(given, 5).collect()
    assert sorted(r["id"] for r in got) == sorted(i for i, _ in rows + odd)
    places = {r["id"]: (r["x"], r["y"]) for r in got}
    assert all(places[i] == (None, None) for i in range(100, 105))
    assert places[105] == places[rows[0][0]] and None not in places[106]
    assert layout.laid_out(given.limit(0)).columns == ["id", "x", "y"] and layout.laid_out(given.limit(0)).count() == 0
    two = spark.createDataFrame([(1, same), (2, same)], "id long, v array<double>")
    assert [tuple(r) for r in layout.laid_out(two).orderBy("id").collect()] == [(1, 0.0, 0.0), (2, 0.0, 0.0)]
