"""3. Packing whole documents into fixed windows by non-negative least squares.

A document's tokens are cut into full windows and one remainder. Of the remainders only the histogram of their lengths
goes to the driver, one number for each length below the window. Shallow combinations of two or three lengths that fill
a window are enumerated, their repeat counts are solved against the histogram by non-negative least squares and rounded
down, and what is left is packed greedily: first by the same combinations, then cut into powers of two, which tile
windows exactly in descending order. The last window ends in sequences of a power of two each, so nothing is padded.

The pieces find their places by their ranks among the pieces of their length, which Spark counts in salted runs.

Rows: a null or empty text is the end token alone; repeated rows are packed each; an empty table gives an empty table;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.bpe import vocabulary
from lexforge.llm.text import map_arrow, texts
from lexforge.operators.ranking import rank_in_groups
from lexforge.plans.tables import materialize

#: Tokens in a sequence; combinations of lengths that are tried at most; sweeps of the solver; id that ends a document.
WINDOW, COMBINATIONS, SWEEPS, END = 1024, 4000, 40, 0

PIECE = "struct<start:bigint,length:bigint,ids_crc32:bigint>"


def powers(length: int) -> list[int]:
    """The powers of two that a number is the sum of, descending."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def pieces(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_tokens, start, length, ids_crc32, parts): full windows and the remainder, which also has the parts it
    would be cut into."""
    end = np.array([END], "<u4").tobytes()

    def make() -> Callable:
        vocab = vocabulary(path)

        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in ("doc_id", "doc_tokens", "start", "length", "ids_crc32", "parts")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = vocab.encode(text) + end
                n = len(ids) // 4
                for at in range(0, n, window):
                    own = ids[4 * at : 4 * (at + window)]
                    size, parts, start = len(own) // 4, [], at
                    for part in powers(size) if size < window else []:
                        parts.append({"start": start, "length": part, "ids_crc32": zlib.crc32(ids[4 * start : 4 * (start + part)])})
                        start += part
                    for name, value in zip(out, (doc, n, at, size, zlib.crc32(own), parts), strict=True):
                        out[name].append(value)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
            return {n: pa.array(x, kind if n == "parts" else pa.int64()) for n, x in out.items()}

        return each

    return map_arrow(texts(docs, id_col, text_col), make, f"doc_id long, doc_tokens long, start long, length long, ids_crc32 long, parts array<{PIECE}>")


def combinations(histogram: np.ndarray, window: int, most: int = COMBINATIONS) -> list[tuple[int, ...]]:
    """Two or three present lengths that sum to the window; all pairs, and the triples whose scarcest length is the most
    frequent."""
    there = np.flatnonzero(histogram)
    found = [(int(a), window - int(a)) for a in there if a <= window - a and histogram[window - a]]
    triples = []
    for a in there:
        b = there[(there >= a) & (window - a - there >= there)]
        c = window - a - b
        ok = histogram[c] > 0
        triples += [(int(min(histogram[a], histogram[x], histogram[y])), int(a), int(x), int(y)) for x, y in zip(b[ok], c[ok], strict=True)]
    triples.sort(key=lambda t: (-t[0], t[1:]))
    return found + [t[1:] for t in triples[: max(0, most - len(found))]]


def solve(histogram: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the combinations' lengths closest to the histogram in least squares, by cyclic
    coordinate descent (every column has three entries at most)."""
    rest = histogram.astype(float).tolist()
    columns = [sorted({(length, combo.count(length)) for length in combo}) for combo in combos]
    norms = [float(sum(m * m for _, m in c)) for c in columns]
    x = [0.0] * len(combos)
    for _ in range(sweeps):
        for j, column in enumerate(columns):
            step = max(-x[j], sum(m * rest[length] for length, m in column) / norms[j])
            if step:
                x[j] += step
                for length, m in column:
                    rest[length] -= m * step
    return np.array(x)


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(combination, repeats) that never use more pieces than there are, and the histogram of what is left."""
    combos = combinations(histogram, window)
    x = solve(histogram, combos)
    left = histogram.copy()
    taken = np.zeros(len(combos), np.int64)

    def take(j: int, n: int) -> None:
        n = min([n, *(int(left[length]) // combos[j].count(length) for length in combos[j])])
        for length in combos[j]:
            left[length] -= n
        taken[j] += n

    for j in range(len(combos)):
        take(j, int(x[j] + 1e-6))
    for j in np.argsort(-(x - np.floor(x)), kind="stable"):
        take(int(j), 1)
    for j in range(len(combos)):
        take(j, 1 << 62)
    return [(c, int(n)) for c, n in zip(combos, taken, strict=True) if n], left


def pack(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece."""
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, window, id_col, text_col))
    histogram = np.zeros(window + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # a row for each length
        histogram[r["length"]] = r["count"]
    full = int(histogram[window])
    histogram[window] = 0
    taken, left = plan(histogram, window)
    places, used, base = [(window, 0, full, 0, 0)], np.zeros(window + 1, np.int64), full
    for combo, n in taken:
        offset = 0
        for length in combo:
            places.append((length, int(used[length]), int(used[length]) + n, base, offset))
            used[length] += n
            offset += length
        base += n
    table = spark.createDataFrame(places, "place_length long, first long, past long, base long, at long")  # rows: parameters' bound
    ranked = rank_in_groups(cut, "length", F.struct("doc_id", "start"))
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("place_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")), "left")
    whole = placed.where("base is not null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("at").alias("offset"))
    parts = placed.where("base is null").select("doc_id", "doc_tokens", F.explode("parts").alias("p")).select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens")
    sizes = {1 << b: int(sum(int(left[length]) for length in range(window) if length >> b & 1)) for b in range(window.bit_length() - 1)}
    starts, tape = {}, 0
    for size in sorted(sizes, reverse=True):
        starts[size] = tape
        tape += size * sizes[size]
    position = F.create_map(*[F.lit(v).cast("long") for kv in starts.items() for v in kv])[F.col("length")] + F.col("rank") * F.col("length")
    laid = rank_in_groups(parts, "length", F.struct("doc_id", "start")).withColumn("position", position)
    windows = tape // window
    sequence, offset = base + F.floor(F.col("position") / window), F.col("position") % window
    edge = windows * window
    for i, size in enumerate(powers(tape % window)):  # the last window, in sequences of a power of two each
        inside = (F.col("position") >= edge) & (F.col("position") < edge + size)
        sequence, offset = F.when(inside, F.lit(base + windows + i)).otherwise(sequence), F.when(inside, F.col("position") - edge).otherwise(offset)
        edge += size
    rest = laid.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
    return whole.unionByName(rest)
