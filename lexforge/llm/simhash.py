"""2. SimHash near-duplicates by multi-index hashing.

Fingerprints: A-Z lower-cased, words, shingles with repeats, XXH64 (seed 42) of each; a bit is set if it is set in over
half of the hashes. Texts without a word have fingerprint zero and are linked like any other.

Linking works on distinct fingerprints. Each is cut into two 32-bit segments. Two fingerprints at ``distance`` 2 or less
differ by one bit at most in one of the segments, so every fingerprint looks up the 33 values of the radius-1 ball of
each of its segments in the table of segments, and the full distance of what it finds is verified. A segment value that
more than ``hot`` fingerprints share would give pairs that grow with its square. Those fingerprints, and all whose ball
holds such a value, take another exact way: each emits the 65 points of the radius-1 ball of its whole fingerprint, and
any two with a common point are within distance 2 (and any two within it have one). A point lies in 65 balls at most, so
that way is linear and even, whatever the data.

Rows: null and empty texts are texts without words; repeated rows are linked; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.text import map_arrow, texts, words_of
from lexforge.operators.graph import connected_components
from lexforge.plans.tables import materialize

SEED = 42
#: Fingerprints that share a segment value before the linear way is taken.
HOT = 200


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Of one text's words, unsigned."""
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = 1 if len(words) < shingle else len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):  # the bits of a part at a time
        ones += np.unpackbits(hashes[at : at + 8192].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long."""

    def make() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            prints = (fingerprint(w, shingle) if (w := words_of(t)) else 0 for t in batch.column(1).to_pylist())
            return {"doc_id": batch.column(0), "fp": pa.array(np.fromiter(prints, np.uint64, batch.num_rows).view(np.int64))}

        return each

    return map_arrow(texts(docs, id_col, text_col), make, "doc_id long, fp long")


def _ball(value: str, bits: int) -> str:
    """SQL array of a value and of those that differ from it in one of the lower ``bits`` bits."""
    return f"concat(array({value}), transform(sequence(0, {bits - 1}), b -> {value} ^ shiftleft(1L, b)))"


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(src, dst) edges whose components are those of the pairs of ``fp`` at Hamming distance 2 or less."""
    low, high = "fp & 4294967295L", "shiftrightunsigned(fp, 32)"
    table = distinct.select("fp", F.explode(F.expr(f"array(struct(0 as seg, {low} as val), struct(1 as seg, {high} as val))")).alias("s")).select("fp", "s.seg", "s.val")
    crowded = materialize(table.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("seg", "val"))
    ball = f"concat(transform({_ball(low, 32)}, v -> struct(0 as seg, v as val)), transform({_ball(high, 32)}, v -> struct(1 as seg, v as val)))"
    probes = distinct.select("fp", F.inline(F.expr(ball)))
    crowds = not crowded.isEmpty()
    sparse = (table.join(crowded, ["seg", "val"], "left_anti") if crowds else table).withColumnRenamed("fp", "other")
    found = probes.join(sparse, ["seg", "val"]).where("fp < other and bit_count(fp ^ other) <= 2").select(F.col("fp").alias("src"), F.col("other").alias("dst"))
    if not crowds:
        return found.distinct()
    near_crowd = probes.join(crowded, ["seg", "val"], "left_semi").select("fp").distinct()
    points = near_crowd.select("fp", F.explode(F.expr(_ball("fp", 64))).alias("point"))
    least = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")  # 65 at most
    star = least.select(F.expr("array_min(fps)").alias("src"), F.explode("fps").alias("dst")).where("src <> dst")
    return found.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links): fingerprint as 16 hex digits; component_id is the smallest id that can
    be reached over links, itself included; n_links the number of other distinct fingerprints in the component."""
    prints = materialize(fingerprints(docs, shingle, id_col, text_col))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = materialize(connected_components(links(distinct.select("fp"), hot)))
    # both sides of a join on a fingerprint or a root that many share come from written tables, so that its rows can be split
    rooted = materialize(distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root")))
    roots = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id"), (F.count(F.lit(1)) - 1).alias("n_links")))
    member = materialize(rooted.join(roots, "root").select("fp", "component_id", "n_links"))
    return prints.join(member, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")
