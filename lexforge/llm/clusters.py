"""11. Centroid clustering with heap-ordered bounds: exact Lloyd rounds in which most vectors are not looked at.

Vectors become integers, floor(scale * x), and lie in blocks. In each block every cluster keeps a heap of its vectors, ordered by
the gap between the distance to the second nearest centroid (a lower bound once centroids move) and to the own one (an upper
bound). When centroids move, a cluster's gaps all shrink by its own drift and the largest drift of another, so only the cluster's
offset grows; the vectors at the heap's top whose gap the offset has used up are popped, compared with all centroids in exact
integers and pushed again. All others keep their cluster, which is what a full scan would give them. A round moves sums of
vectors that changed their cluster, not vectors.

Rows: only vectors with ``dims`` components, none null or non-finite, take part; a null id is kept as it is and comes last as a
seed; repeated rows each count; with fewer vectors than clusters there are as many clusters as vectors; an empty table gives an
empty table; other columns are ignored, whatever their names. Values whose squared distances might not fit into a long are an
error, never wrapped.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.text import map_arrow
from lexforge.plans.tables import discard, materialize

#: Vectors in a block.
BLOCK_ROWS = 4096
#: Squared distances below this are exact in doubles, and beyond the other might not fit into 64 bits.
EXACT, LARGEST = float(1 << 52), float(1 << 62)
#: Share of the largest length by which a gap counts as used up too early: more than the rounding of the bounds.
SLACK = 1e-9
STATE = "ids array<long>, width int, vectors binary, sizes array<int>, heap_at binary, heap_gap binary, moved array<long>, rescanned long, inertia array<long>"


@dataclass
class Clustering:
    """Integer centroids, each cluster's sum of squared distances, and the vectors compared with all centroids in each round;
    ``rows`` has vec_id, cluster and distance."""

    centroids: list[list[int]]
    inertia: list[int]
    rows: DataFrame
    rescanned: list[int] = field(default_factory=list)


def _integers(column: pa.ListArray, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sound rows and their integer vectors."""
    lengths = np.diff(column.offsets.to_numpy())
    places = np.flatnonzero((lengths == dims) & np.asarray(column.is_valid()))
    flat = column.flatten() if column.null_count == 0 else column.values[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
    starts = column.offsets.to_numpy()[:-1] - column.offsets.to_numpy()[0]
    found = values[starts[places][:, None] + np.arange(dims)]
    sound = np.isfinite(found).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(found[sound] * scale)
    if len(scaled) and 4.0 * dims * float(np.abs(scaled).max()) ** 2 >= LARGEST:
        raise OverflowError("squared distances do not fit into 64 bits; take a smaller scale")
    return places[sound], scaled.astype(np.int64)


def _distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All squared distances as integers; by BLAS where doubles hold them exactly."""
    reach = float(max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4.0 * vectors.shape[1] * reach * reach < EXACT else np.int64
    v, c = vectors.astype(kind), centroids.astype(kind)
    found = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)
    return found.astype(np.int64)


def _narrow(vectors: np.ndarray) -> np.ndarray:
    reach = int(np.abs(vectors).max(initial=0))
    return vectors.astype(np.int16 if reach < 1 << 15 else np.int32 if reach < 1 << 31 else np.int64)


def _blocks(vectors: DataFrame, k: int, dims: int, scale: int, salt: str, id_col: str, vector_col: str) -> DataFrame:
    """Blocks whose vectors all lie in the first heap with their gap used up, and each block's first seeds."""

    def make() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            column = batch.column(1)
            places, integers = _integers(column, dims, scale)
            ids = batch.column(0).take(pa.array(places))
            names = [hashlib.sha256(f"{salt}:{x}".encode()).hexdigest() if x is not None else "~" for x in ids.to_pylist()]
            first = heapq.nsmallest(k, range(len(names)), key=lambda i: (names[i], integers[i].tolist()))
            n, narrow = len(places), _narrow(integers)
            block = {
                "ids": (ids.to_pylist(), pa.list_(pa.int64())),
                "width": (narrow.itemsize, pa.int32()),
                "vectors": (narrow.tobytes(), pa.binary()),
                "sizes": ([n] + [0] * (k - 1), pa.list_(pa.int32())),
                "heap_at": (np.arange(n, dtype=np.uint32).tobytes(), pa.binary()),
                "heap_gap": (np.full(n, -np.inf).tobytes(), pa.binary()),
                "moved": (None, pa.list_(pa.int64())),
                "rescanned": (-1, pa.int64()),
                "inertia": (None, pa.list_(pa.int64())),
                "seeds": ([{"name": names[i], "vector": integers[i].tolist()} for i in first], pa.list_(pa.struct([("name", pa.string()), ("vector", pa.list_(pa.int64()))]))),
            }
            return {name: pa.array([value] if n else [], kind) for name, (value, kind) in block.items()}

        return each

    asked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return materialize(map_arrow(asked, make, f"{STATE}, seeds array<struct<name: string, vector: array<long>>>", rows=BLOCK_ROWS))


def _assign(blocks: DataFrame, centroids: np.ndarray, offsets: np.ndarray, last: bool) -> DataFrame:
    """Every block after the vectors whose gap is used up found their nearest centroid. ``moved``: for each cluster the change of
    its count and of its sum; null if no vector moved."""
    k, dims = centroids.shape

    def make() -> Callable:
        def block(row: dict, out: dict) -> None:
            kind = {2: np.int16, 4: np.int32, 8: np.int64}[row["width"]]
            vectors = np.frombuffer(row["vectors"], kind).reshape(-1, dims)
            at, gaps = np.frombuffer(row["heap_at"], np.uint32), np.frombuffer(row["heap_gap"], np.float64)
            fresh = row["rescanned"] < 0
            slack = SLACK * (1 + float(np.abs(vectors).max(initial=0)) * dims + float(np.abs(centroids).max()) * dims + float(offsets.max()))
            heaps, popped, old, start = [], [], [], 0
            for c, n in enumerate(row["sizes"]):
                heap = list(zip(gaps[start : start + n].tolist(), at[start : start + n].tolist(), strict=True))
                start += n
                while heap and heap[0][0] <= offsets[c] + slack:
                    popped.append(heapq.heappop(heap)[1])
                    old.append(c)
                heaps.append(heap)
            moved = np.zeros((k, dims + 1), np.int64)
            if popped:
                asked = vectors[popped].astype(np.int64)
                found = _distances(asked, centroids)
                new = found.argmin(axis=1)  # of equal ones the first
                lengths = np.sqrt(found.astype(np.float64))
                own = lengths[np.arange(len(popped)), new]
                lengths[np.arange(len(popped)), new] = np.inf
                keys = lengths.min(axis=1) - own + offsets[new]
                grown = [[] for _ in range(k)]
                for i, c in enumerate(new.tolist()):
                    grown[c].append((float(keys[i]), popped[i]))
                for c, some in enumerate(grown):
                    if len(some) > len(heaps[c]) // 8:
                        heaps[c] += some
                        heapq.heapify(heaps[c])
                    else:
                        for x in some:
                            heapq.heappush(heaps[c], x)
                changed = np.ones(len(popped), bool) if fresh else new != np.array(old)
                counted = np.hstack([np.ones((len(popped), 1), np.int64), asked])[changed]
                np.add.at(moved, new[changed], counted)
                if not fresh:
                    np.subtract.at(moved, np.array(old)[changed], counted)
            inertia = None
            if last:
                inertia = []
                for c, heap in enumerate(heaps):
                    mine = vectors[[i for _, i in heap]].astype(np.int64)
                    inertia.append(sum(_distances(mine, centroids[c : c + 1]).ravel().tolist()))
                if max(inertia) >= 1 << 63:
                    raise OverflowError("summed distances do not fit into 64 bits; take a smaller scale")
            out["sizes"].append([len(h) for h in heaps])
            out["heap_at"].append(np.array([i for h in heaps for _, i in h], np.uint32).tobytes())
            out["heap_gap"].append(np.array([g for h in heaps for g, _ in h], np.float64).tobytes())
            out["moved"].append(moved.ravel().tolist() if moved.any() else None)
            out["rescanned"].append(len(popped))
            out["inertia"].append(inertia)

        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in ("sizes", "heap_at", "heap_gap", "moved", "rescanned", "inertia")}
            place = batch.schema.get_field_index
            for r in range(batch.num_rows):
                block({n: batch.column(place(n))[r].as_py() for n in ("width", "vectors", "sizes", "heap_at", "heap_gap", "rescanned")}, out)
            kinds = {"sizes": pa.list_(pa.int32()), "heap_at": pa.binary(), "heap_gap": pa.binary(), "moved": pa.list_(pa.int64()), "rescanned": pa.int64(), "inertia": pa.list_(pa.int64())}
            kept = {n: batch.column(place(n)) for n in ("ids", "width", "vectors")}
            return kept | {n: pa.array(out[n], kinds[n]) for n in kinds}

        return each

    return materialize(map_arrow(blocks.select(*[x.split()[0] for x in STATE.split(", ")]), make, STATE, rows=4))


def _summed(blocks: DataFrame, column: str) -> dict[int, int]:
    """Sums of a list's places over all blocks: as many rows as a list has places."""
    return {r["pos"]: int(r["s"]) for r in blocks.select(F.posexplode(column)).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()}


def _rows(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    dims = centroids.shape[1]

    def make() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            ids, clusters, distances = [], [], []
            place = batch.schema.get_field_index
            for r in range(batch.num_rows):
                kind = {2: np.int16, 4: np.int32, 8: np.int64}[batch.column(place("width"))[r].as_py()]
                vectors = np.frombuffer(batch.column(place("vectors"))[r].as_py(), kind).reshape(-1, dims).astype(np.int64)
                at = np.frombuffer(batch.column(place("heap_at"))[r].as_py(), np.uint32)
                cluster = np.repeat(np.arange(len(centroids)), batch.column(place("sizes"))[r].as_py())
                own = batch.column(place("ids"))[r].as_py()
                ids += [own[i] for i in at]
                clusters += cluster.tolist()
                away = vectors[at] - centroids[cluster]
                distances += (away * away).sum(axis=1).tolist()
            return {"vec_id": pa.array(ids, pa.int64()), "cluster": pa.array(clusters, pa.int32()), "distance": pa.array(distances, pa.int64())}

        return each

    return map_arrow(blocks.select("ids", "width", "vectors", "sizes", "heap_at"), make, "vec_id long, cluster int, distance long", rows=4)


def fit(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int = 1024, salt: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """``rounds`` Lloyd rounds from the ``k`` vectors with the smallest sha256 of ``salt:id``, then one more assignment. The driver
    holds k centroids and sums only; each round writes the blocks anew and deletes those before."""
    spark = vectors.sparkSession
    blocks = _blocks(vectors, k, dims, scale, salt, id_col, vector_col)
    seeds = blocks.select(F.explode("seeds").alias("s")).select("s.*").orderBy("name", "vector").limit(k).collect()
    if not seeds:
        return Clustering([], [], spark.createDataFrame([], "vec_id long, cluster int, distance long"))
    centroids = np.array([r["vector"] for r in seeds], np.int64)
    k = len(centroids)
    offsets, sums, rescanned = np.zeros(k), [[0] * (dims + 1) for _ in range(k)], []
    if k < len(blocks.select("sizes").first()["sizes"]):
        blocks = blocks.withColumn("sizes", F.slice("sizes", 1, k))
    written = blocks
    for turn in range(rounds + 1):
        found = _assign(blocks, centroids, offsets, last=turn == rounds)
        rescanned.append(found.agg(F.sum("rescanned")).first()[0])
        if hasattr(written, "_lexforge_path"):
            discard(written)
        blocks = written = found
        if turn == rounds:
            break
        for place, change in _summed(blocks, "moved").items():
            sums[place // (dims + 1)][place % (dims + 1)] += change
        new = np.array([[s // row[0] for s in row[1:]] if row[0] else old.tolist() for row, old in zip(sums, centroids, strict=True)], np.int64)
        drift = np.sqrt(((new - centroids).astype(np.float64) ** 2).sum(axis=1))
        others = np.array([np.delete(drift, c).max(initial=0.0) for c in range(k)])
        centroids, offsets = new, offsets + drift + others
    inertia = _summed(blocks, "inertia")
    return Clustering(centroids.tolist(), [inertia[c] for c in range(k)], _rows(blocks, centroids), rescanned)


def clustered(vectors: DataFrame, k: int, rounds: int, dims: int, **options: object) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    found = fit(vectors, k, rounds, dims, **options)
    if sum(found.inertia) >= 1 << 63:
        raise OverflowError("summed distances do not fit into 64 bits; take a smaller scale")
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]

    def of(values: list, kind: str):
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values] or [F.lit(None).cast(kind)]), F.col("cluster") + 1)

    return found.rows.select("vec_id", "cluster", "distance", of(found.inertia, "long").alias("cluster_inertia"), F.lit(sum(found.inertia)).cast("long").alias("inertia"), of(marks, "string").alias("centroid_sha256"))
