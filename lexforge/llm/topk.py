"""8. Exact top-k by inner product: tiled matrix products of query blocks and candidate shards, a partial selection in
each tile, and a tree of merges of the partial lists.

Vectors become integers, floor(scale * x). Rows that are null or hold null or non-finite components take no part;
vectors are compared with those of their own length only. Candidates of a query's own id are left out. Ties go to the
smaller id; repeated candidate rows each compete; queries that are equal in id and vector are one. A query without any
candidate has no rows; an empty table gives an empty table; other columns are ignored, whatever their names. Scores that
might not fit into a long are an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.text import map_arrow
from lexforge.plans.tables import materialize

#: Vectors in a candidate shard, about as many in a query block, and partial lists in one merge.
SHARD_ROWS, BLOCK_ROWS, FAN_IN = 4096, 1024, 32
#: Groups of shards that a query block is sent to.
GROUPS = 64
#: Inner products whose terms stay below this are exact in doubles.
EXACT = float(1 << 52)
#: Beyond this an inner product may not fit into a long: that is refused, never wrapped.
LARGEST = float(1 << 63)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    v = F.col(vector_col)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the rows and all values."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()


def _products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Integer inner products by BLAS where doubles hold them exactly, else in integers."""
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * max(1, shard.shape[1])
    if reach < EXACT:
        return (queries.astype(np.float64) @ shard.astype(np.float64).T).astype(np.int64)
    if reach >= LARGEST:
        raise OverflowError("inner products do not fit into 64 bits; take a smaller scale")
    return queries @ shard.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one row, ids ascending: highest score, then smallest id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > kth)
        places = np.concatenate([above, np.flatnonzero(scores == kth)[: k - len(above)]])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))]


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's k best among all other rows."""
    sound = integer_vectors(vectors, id_col, vector_col, scale)
    queries = integer_vectors(vectors.where(is_query), id_col, vector_col, scale).distinct()
    queries = materialize(queries.withColumn("query", F.xxhash64("id", "v")))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    block = queries.groupBy(F.pmod(F.col("query"), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("dim")).agg(F.collect_list(F.struct("id", "query", "v")).alias("queries"))

    def shards() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            ids = batch.column(0).to_numpy()
            lengths, values = _matrix(batch.column(1))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            out: dict[str, list] = {"dim": [], "shard": [], "ids": [], "values": []}
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                rows = rows[np.argsort(ids[rows], kind="stable")]
                for at in range(0, len(rows), SHARD_ROWS):
                    part = rows[at : at + SHARD_ROWS]
                    data = values[starts[part][:, None] + np.arange(dim)].astype(np.int64).tobytes()
                    out["dim"].append(int(dim))
                    out["shard"].append(xxhash.xxh64_intdigest(ids[part].tobytes() + data) >> 1)
                    out["ids"].append(ids[part].tobytes())
                    out["values"].append(data)
            return {"dim": pa.array(out["dim"], pa.int32()), "shard": pa.array(out["shard"], pa.int64()), "ids": pa.array(out["ids"], pa.binary()), "values": pa.array(out["values"], pa.binary())}

        return each

    shard = map_arrow(sound, shards, "dim int, shard long, ids binary, values binary")
    # a block meets the shards in groups, so that where it is not broadcast its tiles are dealt over GROUPS tasks
    met = block.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1)))) if blocks > 1 else block.withColumn("group", F.lit(0))
    number = F.pmod(F.col("shard"), F.lit(GROUPS)).cast("int") if blocks > 1 else F.lit(0)
    tiles = shard.withColumn("group", number).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(met, ["block", "group", "dim"])

    def products() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in ("query", "query_id", "shard", "vec_id", "score")}
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in ("dim", "shard", "ids", "values", "queries")}
            for r in range(batch.num_rows):
                dim, number = columns["dim"][r].as_py(), columns["shard"][r].as_py()
                ids = np.frombuffer(columns["ids"][r].as_py(), np.int64)
                shard = np.frombuffer(columns["values"][r].as_py(), np.int64).reshape(len(ids), dim)
                asked = columns["queries"][r].values
                names, marks = asked.field("id").to_numpy(), asked.field("query").to_numpy()
                matrix = asked.field("v").flatten().to_numpy().reshape(len(names), dim)
                for q, row in enumerate(_products(matrix, shard)):
                    others = ids != names[q]
                    own_ids, scores = (ids, row) if others.all() else (ids[others], row[others])
                    best = _best(scores, own_ids, k)
                    out["query"] += [int(marks[q])] * len(best)
                    out["query_id"] += [int(names[q])] * len(best)
                    out["shard"] += [number] * len(best)
                    out["vec_id"] += own_ids[best].tolist()
                    out["score"] += scores[best].tolist()
            return {n: pa.array(x, pa.int64()) for n, x in out.items()}

        return each

    lists = map_arrow(tiles.select("dim", "shard", "ids", "values", "queries"), products, "query long, query_id long, shard long, vec_id long, score long")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k)
    flat = lists.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(FAN_IN)))
    for keys in (["query", "query_id", "part"], ["query", "query_id"]):
        merged = flat.groupBy(*keys).agg(best.alias("best"))
        flat = merged.select(*keys, F.posexplode("best").alias("at", "b")).select(*keys, (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score"))
    return flat.select("query_id", "rank", "vec_id", "score")
