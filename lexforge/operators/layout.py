"""A two-dimensional map that keeps neighbours together: a graph of nearest neighbours and its slowest eigenvectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.plans.tables import discard, materialize, scratch

#: Rows of a cell that are compared with each other, pivots that a cell is cut by at once, and cuts in a row at most.
BLOCK, PIVOTS, LEVELS = 2048, 64, 6
#: Neighbours of a row, independent ways of cutting the rows into cells.
NEIGHBOURS, TREES = 15, 4
#: Vectors that are iterated together, and rounds between two orthonormalisations.
COLUMNS, EACH = 8, 5
#: Least weight of an edge, so that every row with a neighbour has a degree.
FAINT = 1e-6


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v) with v null where it has fewer components than the longest or a null or non-finite one."""
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    wide = vectors.select("id", F.when(fine & (F.size("v") > 0), F.transform("v", lambda x: x.cast("double"))).alias("v"))
    size = wide.agg(F.max(F.size("v"))).first()[0]
    return wide.select("id", F.when(F.size("v") == F.lit(size), F.col("v")).alias("v"))


def _draw(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "id")


def cells(rows: DataFrame, block: int, seed: int) -> DataFrame:
    """(cell, id, v): rows go to the most similar of some of their cell's rows until a cell has at most ``block``, or ``LEVELS``
    times. A cell is cut into about as many as it has half blocks. Only counts of cells and their pivots, both bounded for each
    cell, are joined to its rows, in packs."""
    done: list[DataFrame] = []
    left = rows.select(F.lit(0).cast("long").alias("cell"), "id", "v")
    for level in range(LEVELS):
        if level:
            sized = left.join(materialize(left.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))), "cell")
        else:
            sized = left.withColumn("n", F.lit(left.count()))
        done.append(sized.where(F.col("n") <= block).drop("n"))
        wide = sized.where(F.col("n") > block).withColumn("h", _draw(seed * LEVELS + level))
        if wide.isEmpty():
            return _all(done)
        some = F.pmod(F.col("h"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * 2 * PIVOTS / F.col("n")
        want = F.least(F.lit(PIVOTS), F.ceil(2 * F.col("n") / block)).cast("int")
        marks = wide.where(some).groupBy("cell", "n").agg(F.array_sort(F.collect_list(F.struct("h", "id", "v"))).alias("m"))
        marks = marks.select("cell", F.transform(F.slice("m", F.lit(1), want), lambda m: m["v"]).alias("pivots"))
        pack = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block)).alias("pack")
        packs = wide.groupBy("cell", pack).agg(F.collect_list(F.struct("id", "v")).alias("rows")).join(marks, "cell", "left")
        placed = packs.select("cell", "rows", "pivots").mapInPandas(_place, "cell long, pivot int, id long, v array<double>")
        left = materialize(placed.select(F.xxhash64("cell", "pivot").alias("cell"), "id", "v"))
    done.append(left)
    return _all(done)


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for cell, rows, pivots in zip(batch["cell"], batch["rows"], batch["pivots"], strict=True):
            v = np.array([r["v"] for r in rows], float)
            nearest = np.zeros(len(rows), "int32")
            if pivots is not None:  # none were drawn: the cell stays whole for this time
                nearest = (v @ np.array([list(p) for p in pivots], float).T).argmax(axis=1).astype("int32")
            yield pd.DataFrame({"cell": cell, "pivot": nearest, "id": [r["id"] for r in rows], "v": list(v)})


def _closest(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in batch["rows"]:
                ids = np.array([r["id"] for r in rows])
                order = np.argsort(ids, kind="stable")
                ids, v = ids[order], np.array([r["v"] for r in rows], float)[order]
                s = np.round(v @ v.T, 9)
                np.fill_diagonal(s, -np.inf)
                best = np.argsort(-s, axis=1, kind="stable")[:, : min(k, len(ids) - 1)]
                at = np.repeat(np.arange(len(ids)), best.shape[1])
                yield pd.DataFrame({"id": ids[at], "other": ids[best.ravel()], "similarity": s[at, best.ravel()]})

    return run


def graph(vectors: DataFrame, k: int = NEIGHBOURS, trees: int = TREES, block: int = BLOCK) -> DataFrame:
    """(id, other, similarity): for each row of (id, v) up to ``k`` others of the largest inner product, ties to the smaller id.

    Rows are cut into cells of similar ones in ``trees`` independent ways, and compared within cells: work grows with the rows,
    not with their pairs. Up to ``block`` rows are one cell, and the result is exact; of more, a neighbour is missed if all ways
    part it from its row. Cells that stay crowded are cut by a hash. One row has no neighbours."""
    found = None
    for seed in range(trees if vectors.limit(block + 1).count() > block else 1):
        cut = materialize(cells(vectors, block, seed))
        sizes = cut.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("packs"))
        packs = cut.join(sizes, "cell").groupBy("cell", F.pmod(F.xxhash64("id"), "packs")).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
        near = packs.select("rows").mapInPandas(_closest(k), "id long, other long, similarity double")
        found = near if found is None else found.unionByName(near)
    best = found.groupBy("id").agg(F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("minus"), "other"))).alias("m"))
    return best.select("id", F.explode(F.slice("m", 1, k)).alias("m")).select("id", "m.other", (-F.col("m.minus")).alias("similarity"))


def undirected(edges: DataFrame) -> DataFrame:
    """(id, other, w): each edge both ways once, weighted by its similarity."""
    w = F.greatest(F.col("similarity"), F.lit(FAINT)).alias("w")
    both = edges.select("id", "other", w).unionByName(edges.select(F.col("other").alias("id"), F.col("id").alias("other"), w))
    return both.groupBy("id", "other").agg(F.max("w").alias("w"))


def walk(nodes: DataFrame, edges: DataFrame, names: list[str]) -> DataFrame:
    """One step of the lazy random walk: each column becomes the mean of itself and of its weighted mean over neighbours."""
    met = edges.join(nodes.select(F.col("id").alias("other"), *names), "other")
    sums = met.groupBy("id").agg(*[F.sum(F.col("w") * F.col(n)).alias(f"s_{n}") for n in names])
    mean = [((F.col(n) + F.coalesce(F.try_divide(F.col(f"s_{n}"), F.col("d")), F.lit(0.0))) / 2).alias(n) for n in names]
    return nodes.join(sums, "id", "left").select("id", "d", *mean)


def _moments(nodes: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """Sums of d * l * r over all rows."""
    row = nodes.agg(*[F.coalesce(F.sum(F.col("d") * F.col(a) * F.col(b)), F.lit(0.0)) for a in left for b in right]).first()
    return np.array(row, float).reshape(len(left), len(right))


def _turned(nodes: DataFrame, names: list[str], turn: np.ndarray, shift: np.ndarray) -> tuple[DataFrame, list[str]]:
    """Columns less their shifts, times a matrix."""
    out = [f"x{j}" for j in range(turn.shape[1])]
    made = [sum(((F.col(n) - float(s)) * float(t) for n, s, t in zip(names, shift, turn[:, j], strict=True)), F.lit(0.0)).alias(o) for j, o in enumerate(out)]
    return nodes.select("id", "d", *made), out


def _orthonormal(nodes: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Without the constant, of length one and at right angles by degrees. Directions that the others span go."""
    held = nodes.withColumn("one", F.lit(1.0))
    all_moments = _moments(held, [*names, "one"], [*names, "one"])
    total = all_moments[-1, -1]
    shift = all_moments[-1, :-1] / total if total else np.zeros(len(names))
    gram = all_moments[:-1, :-1] - total * np.outer(shift, shift)
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-10 * max(values.max(initial=0), 1e-30)
    return _turned(nodes, names, turn[:, keep] / np.sqrt(values[keep]), shift)


def spectral(starts: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, x, y): the two eigenvectors of the random walk on the graph that change slowest along its edges, but for the constant.

    ``starts`` has the columns of a first guess beside id; they are iterated together, and at the end turned so that the first
    two are the best that they span. A round joins edges with values once and sums up partly before it shuffles; the driver has
    matrices of a column by a column. A node without edges is at (0, 0), as all are where no direction is left."""
    names = [n for n in starts.columns if n != "id"]
    degrees = edges.groupBy("id").agg(F.sum("w").alias("d"))
    nodes = starts.join(degrees, "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d"), *names)
    held = None
    for done in range(rounds):
        if done % EACH == 0:
            nodes, names = _orthonormal(nodes, names)
            if not names:
                break
        nodes = materialize(walk(nodes, edges, names))
        if held is not None:
            discard(held)
        held = nodes
    if names:
        nodes, names = _orthonormal(nodes, names)
    if not names:
        return starts.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    nodes = materialize(nodes)
    after = walk(nodes, edges, names).select("id", *[F.col(n).alias(f"p_{n}") for n in names])
    change = _moments(nodes.join(after, "id"), names, [f"p_{n}" for n in names])
    values, turn = np.linalg.eigh((change + change.T) / 2)
    turn = turn[:, np.argsort(-values, kind="stable")[:2]]
    turn = turn * np.where(turn[np.abs(turn).argmax(axis=0), np.arange(turn.shape[1])] < 0, -1, 1)
    placed, axes = _turned(nodes, names, turn, np.zeros(len(names)))
    x, y = [F.when(F.col("d") > 0, F.col(a)).otherwise(F.lit(0.0)) for a in axes] + [F.lit(0.0)] * (2 - len(axes))
    return placed.select("id", x.alias("x"), y.alias("y"))


def laid_out(vectors: DataFrame, k: int = NEIGHBOURS, rounds: int = 10, trees: int = TREES, block: int = BLOCK) -> DataFrame:
    """(id, x, y) of each row of (id, v): ``spectral`` over its neighbour graph, starting from principal components.

    Equal vectors are one node and share a place. Vectors that are null, shorter than the longest or hold null or non-finite
    components have null places; two nodes or fewer are at (0, 0). ``v`` should be of length one."""
    with scratch(vectors.sparkSession) as keep:
        whole = usable(vectors)
        nodes = materialize(whole.where("v is not null").groupBy("v").agg(F.min("id").alias("id")))
        if nodes.limit(3).count() < 3:
            places = nodes.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        else:
            edges = materialize(undirected(graph(nodes, k, trees, block)))
            rows = nodes.select("id", array_to_vector("v").alias("f"))
            cols = min(COLUMNS, nodes.select(F.size("v")).first()[0])
            guess = PCA(k=cols, inputCol="f", outputCol="p").fit(rows).transform(rows).select("id", vector_to_array("p").alias("p"))
            starts = materialize(guess.select("id", *[F.col("p")[j].alias(f"x{j}") for j in range(cols)]))
            places = spectral(starts, edges, rounds)
        at = nodes.select("v", F.col("id").alias("node")).join(places.withColumnRenamed("id", "node"), "node").select("v", "x", "y")
        return keep(whole.join(at, "v", "left").select("id", "x", "y"))
