"""Exact and near duplicates of documents, titles and entities."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.operators.graph import FEW_EDGES, connected_components
from lexforge.operators.retrieval import few, in_passes
from lexforge.plans.tables import materialize

TOKEN = "[\\p{L}\\p{N}_]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def md5_simhash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): 64-bit SimHash over tokens with their multiplicity and the low half of their md5; a bit is set if its sum is
    over 0; 0 without tokens. A document's tokens are exploded and summed up in the same task, so the shuffle moves a row of
    32 sums for each document, of two bits each, not its tokens; no Python runs."""
    exploded = docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("w"))
    low = exploded.select("id", F.conv(F.substring(F.md5(F.col("w").cast("binary")), 17, 16), 16, -10).cast("long").alias("h"))
    ones = [F.sum(F.expr(f"shiftrightunsigned(h, {b}) & {1 << 32 | 1}L")).alias(f"b{b}") for b in range(32)]  # of bits b and b + 32
    bits = low.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *ones)
    halves = [" | ".join(f"if(2 * ({part.format(b=b)}) > n, {1 << b}L, 0L)" for b in range(32)) for part in ("b{b} & 4294967295L", "shiftrightunsigned(b{b}, 32)")]
    fp = F.expr(f"({halves[0]}) | shiftleft({halves[1]}, 32)")
    return docs.select(F.col(id_col).alias("id")).join(bits.select("id", fp.alias("fp")), "id", "left").select("id", F.coalesce("fp", F.lit(0)).cast("long").alias("fp"))


#: Prints that may share a segment's value before the rest of their bits has to tell them apart, and bits that can.
CROWDED, LEAST_BITS = 256, 12
#: Prints that every worker holds at once, and pairs that are compared without looking up segments.
PASS_PRINTS, DIRECT_PAIRS = 1 << 20, 1 << 16
#: Prints whose pairs are put together, so that each is given once.
SLICE = 1024


def _packed(places: Sequence[int]) -> str:
    """SQL for these bits of ``fp``, one after the other."""
    runs: list[list[int]] = []
    for at in places:
        if runs and runs[-1][0] + runs[-1][1] == at:
            runs[-1][1] += 1
        else:
            runs.append([at, 1])
    terms, shift = [], 0
    for start, length in runs:
        terms.append(f"shiftleft(shiftrightunsigned(fp, {start}) & {(1 << length) - 1}L, {shift})")
        shift += length
    return f"({' | '.join(terms)})"


def segments(places: Sequence[int], distance: int) -> list[list[int]]:
    """``distance // 2 + 1`` segments of the bits, two at least: prints within the distance differ by one bit at most in one."""
    parts = max(2, distance // 2 + 1)
    return [list(places[len(places) * i // parts : len(places) * (i + 1) // parts]) for i in range(parts)]


def segment_keys(cut: Sequence[Sequence[int]], first: int, near: bool, above: str = "0L") -> Column:
    """Of ``fp`` an array of (path, key), a key for each segment: of its own value or, with ``near``, of all values within one bit.
    Paths are numbered from ``first``. Keys are hashes, so what shares one has to be verified."""
    made = []
    for i, places in enumerate(cut):
        own = _packed(places)
        values = f"concat(array({own}), transform(sequence(0, {len(places) - 1}), x -> ({own}) ^ shiftleft(1L, x)))" if near else f"array({own})"
        made.append(f"transform({values}, v -> struct({first + i} AS path, xxhash64({above}, {first + i}, v) AS key))")
    return F.expr(f"concat({', '.join(made)})")


def _bits(prints: np.ndarray, places: Sequence[int]) -> np.ndarray:
    """These bits of the prints, one after the other."""
    found = np.zeros(len(prints), np.uint64)
    for shift, at in enumerate(places):
        found |= (prints >> np.uint64(at) & np.uint64(1)) << np.uint64(shift)
    return found


def near_prints(asking: np.ndarray, prints: np.ndarray, distance: int, places: Sequence[int], crowded: int, least: int, direct: int, index: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of asking prints and of prints within the distance, where all bits but ``places`` are out of the question. Each looks up
    all values within one bit of its own in each segment. Where more than ``crowded`` have one value, the bits outside of the segment
    are cut again; up to ``direct`` pairs, or with fewer than ``least`` bits, all are compared. ``index`` keeps sorted segments."""

    def compared(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.bitwise_count(asking[i] ^ prints[j]) <= distance
        return i[ok], j[ok]

    if len(asking) * len(prints) <= direct or len(places) < least:
        step = max(1, (1 << 20) // max(1, len(prints)))
        for at in range(0, len(asking), step):
            i, j = np.nonzero(np.bitwise_count(asking[at : at + step, None] ^ prints[None, :]) <= distance)
            yield i + at, j
        return
    for number, cut in enumerate(segments(places, distance)):
        if index is None or number not in index:
            keys = _bits(prints, cut)
            order = np.argsort(keys, kind="stable")
            kept = keys[order], order
            if index is not None:
                index[number] = kept
        else:
            kept = index[number]
        keys, order = kept
        own = _bits(asking, cut)
        by = np.argsort(own, kind="stable")
        rest = [x for x in places if x not in cut]
        for flip in [0, *(1 << x for x in range(len(cut)))]:
            sought = own[by] ^ np.uint64(flip)
            first = np.searchsorted(keys, sought)
            some = np.flatnonzero(keys[np.minimum(first, len(keys) - 1)] == sought) if len(keys) else np.zeros(0, np.int64)
            first, sought, who = first[some], sought[some], by[some]
            n = np.searchsorted(keys, sought, "right") - first
            few_have = n <= crowded
            for at in range(0, int(few_have.sum()), 1 << 14):
                i, start, many = (x[few_have][at : at + (1 << 14)] for x in (who, first, n))
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
                yield compared(np.repeat(i, many), order[place])
            for start in np.unique(first[~few_have]):
                them = who[~few_have & (first == start)]
                those = order[start : start + n[first == start][0]]
                for i, j in near_prints(asking[them], prints[those], distance, rest, crowded, least, direct):
                    yield them[i], those[j]


def candidate_pairs(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, fp2), fp < fp2, of distinct prints within the distance, each pair once.

    Prints are eight bytes each: blocks of them, sorted by their segments, come to the tasks in passes, so no print is shuffled,
    however many values it looks up and however many share one."""
    most, limits = PASS_PRINTS, (CROWDED, LEAST_BITS, DIRECT_PAIRS)

    def work(block: pa.Table) -> Callable:
        held = np.sort(block.column("qid").to_numpy()).view(np.uint64)
        index: dict = {}

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = np.array(batch.column(0).to_numpy()).view(np.uint64)
                for at in range(0, len(own), SLICE):
                    some, found = own[at : at + SLICE], [np.zeros(0, np.int64)]
                    for i, j in near_prints(some, held, distance, range(64), *limits, index):
                        later = some[i].view(np.int64) < held[j].view(np.int64)
                        found.append(i[later] * len(held) + j[later])
                    once = np.unique(np.concatenate(found))
                    for start in range(0, len(once), 100_000):
                        i, j = np.divmod(once[start : start + 100_000], len(held))
                        yield pa.RecordBatch.from_arrays([pa.array(some[i].view(np.int64)), pa.array(held[j].view(np.int64))], names=["fp", "fp2"])

        return each

    schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("fp2", T.LongType())])
    return in_passes(prints.select("fp"), prints.select(F.col("fp").alias("qid")), most, F.lit(8), work, schema)


def banded_pairs(prints: DataFrame, distance: int) -> DataFrame:
    """(a, b, distance), a < b as signed numbers: distinct fingerprints at Hamming ``distance`` or less."""
    d = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2")))
    found = candidate_pairs(materialize(prints.select("fp").distinct()), distance)
    return found.select(F.col("fp").alias("a"), F.col("fp2").alias("b"), d.cast("int").alias("distance"))


def near_earlier(known: DataFrame, distance: int) -> DataFrame:
    """(id) of the rows of (id, fp, registers) that have an earlier row, one that registers, within ``distance``: the outcome of
    a registry that grows in the order of the ids. Of each fingerprint only its first such row matters. Zero is no
    fingerprint."""
    known = known.where("fp <> 0")
    first = materialize(known.where("registers").groupBy("fp").agg(F.min("id").alias("first")))
    pairs = materialize(banded_pairs(known, distance))
    a, b = F.col("a"), F.col("b")
    both = pairs.select(a.alias("fp"), b.alias("other")).unionByName(pairs.select(b.alias("fp"), a.alias("other")))
    both = both.unionByName(known.select("fp", F.col("fp").alias("other")).distinct())
    earliest = materialize(both.join(first.withColumnRenamed("fp", "other"), "other").groupBy("fp").agg(F.min("first").alias("first")))
    return known.join(earliest, "fp").where("first < id").select("id")


def clusters(prints: DataFrame, distance: int) -> DataFrame:
    """(id, cluster): the smallest id that links of ``distance`` or less reach. Equal fingerprints are linked."""
    prints = materialize(prints)
    groups = connected_components(banded_pairs(prints, distance).select(F.col("a").alias("src"), F.col("b").alias("dst")), few=FEW_EDGES)
    rooted = prints.join(groups, prints.fp == groups.node, "left").select("id", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("cluster"))
    return rooted.join(least, "root").select("id", "cluster")


def survivors(members: DataFrame) -> DataFrame:
    """(id, cluster, score, keep) of (id, cluster, signal_processed, pub_date, source_type, size): 3 for processed signals,
    2 for a date, 1 for a preferred source, 1 for at least the cluster's upper median size; the best, then smallest id, stays.
    Clusters of one have no loser. The median is a rank in the cluster's size histogram, not a list of its members."""
    sized = members.groupBy("cluster", "size").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cluster").orderBy("size")
    upto = sized.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("cluster")))
    median = upto.where("upto > floor(all / 2)").groupBy("cluster").agg(F.min("size").alias("median"), F.max("all").alias("all"))
    score = (
        F.when(F.coalesce("signal_processed", F.lit(False)), 3).otherwise(0)
        + F.when(F.coalesce("pub_date", F.lit("")) != "", 2).otherwise(0)
        + F.when(F.coalesce(F.col("source_type").isin("pdf", "html"), F.lit(False)), 1).otherwise(0)
        + F.when(F.col("size") >= F.col("median"), 1).otherwise(0)
    )
    scored = members.join(median, "cluster").where("all > 1").select("id", "cluster", score.alias("score"))
    best = scored.groupBy("cluster").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("m"))
    return scored.join(best, "cluster").select("id", "cluster", "score", (F.col("id") == -F.col("m.minus")).alias("keep"))


def marked_losers(content: DataFrame, judged: DataFrame, distance: int) -> DataFrame:
    """Content rows with the losers of survivors() marked for deletion, rejected, and told what stays for them; other
    columns, such as whether a vector is wanted, are left as they are."""
    winner = judged.where("keep").select("cluster", F.col("id").alias("_winner"))
    lost = judged.where("not keep").select("cluster", F.col("id").alias("_loser")).join(winner, "cluster")
    joined = content.join(lost, F.col("id") == F.col("_loser"), "left")
    gone = F.col("_loser").isNotNull()
    reason = F.concat(F.lit(f"near_duplicate: simhash_dist≤{distance}, kept id="), F.col("_winner").cast("string"))
    new = {
        "marked_for_deletion": gone | F.coalesce(F.col("marked_for_deletion"), F.lit(False)) if "marked_for_deletion" in content.columns else gone,
        "screening_status": F.when(gone, "dq_rejected").otherwise(F.col("screening_status")),
        "screening_reason": F.when(gone, reason).otherwise(F.col("screening_reason")),
    }
    return joined.withColumns(new).drop("_loser", "_winner", "cluster")


def not_newest(rows: DataFrame, key: str, stamp: str, id_col: str = "id") -> DataFrame:
    """Ids of all rows of a key but its newest; rows that are marked already count, too."""
    best = rows.groupBy(key).agg(F.max(F.struct(stamp, id_col)).alias("m"))
    return rows.join(best, key).where(F.col(id_col) != F.col(f"m.{id_col}")).select(id_col)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


#: Counters of the tokens' frequencies and of a row of them, longs of a set's parities in a prefix and in its outline, and rows of copies that are broadcast.
COUNTERS, CHUNK, PARITIES, OUTLINE, COPIES = 1 << 22, 1 << 14, 4, 64, 500_000
#: Pairs of a row that are one part, and pairs of a cell or so, in which pairs are verified.
CELL_PAIRS, CELL_SETS = 20_000, 2_000


def _tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (ord, s): the sets' sizes, the number of its row for each token, and the tokens."""
    column = batch.column(1)
    sizes = np.diff(column.offsets.to_numpy())
    return sizes, np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy()


def _parities(sizes: np.ndarray, row: np.ndarray, s: np.ndarray, longs: int) -> np.ndarray:
    """For each set ``longs`` longs: whether its tokens of each of so many times 64 buckets are odd in number."""
    odd = np.bincount(row * (64 * longs) + ((s >> 24) & (64 * longs - 1)), minlength=len(sizes) * 64 * longs) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sizes), -1), axis=1).view(np.int64).reshape(len(sizes), longs)


def frequencies(sets: DataFrame) -> np.ndarray:
    """Of (ord, s), sets of 64-bit tokens: rows that hold a token of a counter, for COUNTERS counters. A task counts in one array."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            np.add.at(found, _tokens_of(batch)[2] & (COUNTERS - 1), 1)
        parts = [found[i : i + CHUNK] for i in range(0, COUNTERS, CHUNK)]
        some = [i for i, part in enumerate(parts) if part.any()]
        for i in range(0, len(some), 64):
            packed = [zlib.compress(parts[x].tobytes(), 1) for x in some[i : i + 64]]
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 64], pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in group.column("counts").to_pylist())
        return pa.table({"part": group.column("part")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    every = np.zeros(COUNTERS, np.int32)
    for row in sets.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        every[row["part"] * CHUNK : (row["part"] + 1) * CHUNK] = np.minimum(np.frombuffer(zlib.decompress(row["counts"]), np.int64), np.iinfo(np.int32).max)
    return every


def jaccard_candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) pairs of ``ord``, a < b, of those of (ord, s) that may reach the threshold; ``s`` are distinct 64-bit tokens.

    Prefix filter: with tokens in one order (rarest first, as far as COUNTERS counters tell), the smaller of two similar sets has a
    token of its first n - ceil(2 t / (1 + t) n) + 1 among the first n - ceil(t n) + 1 of the larger one. Tokens that no other
    set has stay at home. Places in the order bound the overlap, and so do parities of the tokens' counts in buckets, which differ
    in as many places at most as the sets have tokens apart. A task orders the tokens that it reads: no token is shuffled but
    those of prefixes."""
    held = sets.sparkSession.sparkContext.broadcast(frequencies(sets))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = held.value
        for batch in batches:
            sizes, row, s = _tokens_of(batch)
            n = count[s & (COUNTERS - 1)]
            order = np.lexsort((s, n, row))
            place = np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # row is sorted already
            size = sizes[row]
            probe = size - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1
            index = size - np.ceil(size * (2 * threshold / (1 + threshold)) - 1e-9).astype(np.int64) + 1
            take = np.flatnonzero((place < probe) & (n[order] > 1))
            words = _parities(sizes, row, s, PARITIES)
            ords = batch.column(0).take(pa.array(row[take]))
            columns = [pa.array(s[order[take]]), ords, pa.array(size[take].astype(np.int32)), pa.array(place[take].astype(np.int32)), pa.array((place < index)[take]), *(pa.array(words[row[take], i]) for i in range(PARITIES))]
            yield pa.RecordBatch.from_arrays(columns, names=["t", "ord", "n", "at", "index", *odds])

    odds = [f"p{i}" for i in range(PARITIES)]
    prefix = sets.mapInArrow(prefixes, "t long, ord long, n int, at int, index boolean, " + ", ".join(f"{x} long" for x in odds))
    side = lambda rows, x: rows.select("t", F.col("ord").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at_{x}"), *(F.col(o).alias(f"{o}{x}") for o in odds))
    larger = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    most = F.least("at_a", "at_b") + 1 + F.least(F.col("na") - F.col("at_a") - 1, F.col("nb") - F.col("at_b") - 1)
    needed = (F.col("na") + F.col("nb")) * F.lit(threshold / (1 + threshold)) - 1e-6
    apart = sum(F.bit_count(F.col(f"{o}a").bitwiseXOR(F.col(f"{o}b"))) for o in odds)
    may = larger & (F.col("nb") >= F.col("na") * F.lit(threshold) - 1e-9) & (most >= needed) & ((F.col("na") + F.col("nb") - apart) / 2 >= needed)
    met = side(prefix, "a").join(side(prefix.where("index"), "b"), "t").where(may)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def in_cells(sets: DataFrame, pairs: DataFrame, like: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """Those of a written table (a, b), a < b, whose arrays ``s`` of (ord, s) are ``like``. What is alike meets in few cells: a pair's
    cell is that of the smallest row that its first one is paired with, so an array is sent to few of them, not once for each pair."""
    lower = pairs.groupBy(F.col("b").alias("ord")).agg(F.min("a").alias("low"))
    rooted = pairs.join(lower, F.col("a") == F.col("ord"), "left").select("a", "b", F.coalesce("low", "a").alias("root"))
    split = rooted.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / CELL_PAIRS).alias("parts"))
    cells = max(1, -(-pairs.count() // CELL_SETS))
    cell = F.pmod(F.xxhash64("root", F.pmod(F.xxhash64("a"), F.col("parts"))), F.lit(cells)).cast("int")
    placed = materialize(rooted.join(split, "root").select(cell.alias("cell"), "a", "b"))
    ends = materialize(placed.select("cell", F.explode(F.array("a", "b")).alias("ord")).distinct())
    members = sets.join(few(ends, COPIES), "ord").select("cell", "ord", "s")

    def check(these: pa.Table, those: pa.Table) -> pa.Table:
        s = those.column("s").combine_chunks()
        offsets, values = s.offsets.to_numpy(), s.flatten().to_numpy()
        offsets = offsets - (offsets[0] if len(offsets) else 0)
        at = {o: i for i, o in enumerate(those.column("ord").to_pylist())}
        of = lambda o: values[offsets[at[o]] : offsets[at[o] + 1]]
        kept = [r for r, (a, b) in enumerate(zip(these.column("a").to_pylist(), these.column("b").to_pylist(), strict=True)) if like(of(a), of(b))]
        return these.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return placed.groupBy("cell").cogroup(members.groupBy("cell")).applyInArrow(check, "a long, b long")


def outlined(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of a written table (a, b) that may reach the threshold by an outline of each set: its size and parities of OUTLINE longs,
    which tell long sets apart that a prefix's parities do not."""

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                sizes, row, s = _tokens_of(batch)
                lines = np.concatenate([sizes[:, None].astype(np.int64), _parities(sizes, row, s, OUTLINE)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * (OUTLINE + 1), lines.reshape(-1))], names=["ord", "s"])

    def like(x: np.ndarray, y: np.ndarray) -> bool:
        both, apart = int(x[0] + y[0]), int(np.bitwise_count((x[1:] ^ y[1:]).view(np.uint64)).sum())
        return (both - apart) / 2 >= both * threshold / (1 + threshold) - 1e-6

    return in_cells(sets.mapInArrow(outline, "ord long, s array<long>"), pairs, like)


def verified(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of a written table (a, b) whose sets reach the threshold."""

    def like(x: np.ndarray, y: np.ndarray) -> bool:
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common / (len(x) + len(y) - common) >= threshold

    return in_cells(sets, pairs, like)


def _greedy(pairs: pd.DataFrame) -> list[int]:
    """What goes of (a, b), a < b, if each node in turn stays unless an earlier neighbour of it stayed."""
    gone: set[int] = set()
    for a, b in sorted(zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True)):  # all pairs of earlier nodes come before
        if a not in gone:
            gone.add(b)
    return sorted(gone)


#: Rounds between two looks at the components that are left.
ROUNDS = 3


def settled(pairs: DataFrame) -> DataFrame | None:
    """(ord) of the nodes of a written table (a, b), a < b, that go in the greedy order; null if there is no pair.

    A few pairs are decided in one task, however long their chains are. Of more, rounds decide what can be seen at once (a node
    without an earlier undecided neighbour stays, its later neighbours go, with their pairs); what is left after some rounds
    falls into components, and each of these that has few pairs is decided in one task. Only larger ones need further rounds."""
    live, gone, turn = pairs, [], 0

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            yield pd.DataFrame({"ord": _greedy(pd.concat(held))})

    while left := live.count():
        if left <= FEW_EDGES:
            gone.append(live.select("a", "b").coalesce(1).mapInPandas(alone, "ord long"))
            break
        turn += 1
        if turn % ROUNDS == 0:
            groups = connected_components(live, "a", "b")
            rooted = live.join(groups, F.col("a") == F.col("node")).select("a", "b", "component")
            sizes = rooted.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
            rooted = materialize(rooted.join(sizes, "component"))
            small = rooted.where(F.col("n") <= FEW_EDGES)
            gone.append(materialize(small.groupBy("component").applyInPandas(lambda g: pd.DataFrame({"ord": _greedy(g)}), "ord long")))
            live = materialize(rooted.where(F.col("n") > FEW_EDGES).select("a", "b"))
            continue
        waits = live.select(F.col("b").alias("ord")).distinct()
        stays = live.select(F.col("a").alias("ord")).distinct().join(waits, "ord", "left_anti")
        drop = materialize(live.join(stays, F.col("a") == F.col("ord"), "left_semi").select(F.col("b").alias("ord")).distinct())
        gone.append(drop)
        rest = live.join(drop.withColumnRenamed("ord", "b"), "b", "left_anti").join(drop.withColumnRenamed("ord", "a"), "a", "left_anti")
        live = materialize(rest.select("a", "b"))
    return reduce(DataFrame.unionAll, gone) if gone else None


def leaders(rows: DataFrame, threshold: float, scope: Sequence[str] = ()) -> DataFrame:
    """(ord, keep): greedy clustering in the order of ``ord``: a row stays unless it is similar to one that stayed before it.
    Rows without tokens stay.

    A token of a scope is named by 64 bits. Equal token sets of a scope are one from the beginning, as all but the first of them go;
    they are known by 128 bits. Pairs of distinct sets that may be similar come from a prefix-filtered join. Of many, those of a set
    without an earlier one, which stays, are verified first, and what goes for it takes its pairs along, so of a crowd of near copies
    each is held against few. ``settled`` decides over what is left and verified."""
    within = [x for name in scope for x in (F.col(name).isNull(), F.col(name))]
    tokens = F.sort_array(F.array_distinct(F.transform(F.coalesce("tokens", F.array()), lambda t: F.xxhash64(*within, t))))
    rows = materialize(rows.select(F.col("ord").cast("long").alias("ord"), tokens.alias("s")))
    full = rows.where(F.size("s") > 0)
    named = full.select("ord", F.xxhash64("s").alias("x"), F.xxhash64(F.lit("second"), "s").alias("y"))
    first = named.groupBy("x", "y").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = materialize(named.join(first, ["x", "y"]).where("ord <> first").select("ord"))
    sets = full.join(few(copies, COPIES), "ord", "left_anti")
    pairs = materialize(jaccard_candidates(sets, threshold))
    pairs = materialize(outlined(full, pairs, threshold))
    lost = [copies]
    for _ in range(ROUNDS):
        if pairs.count() <= FEW_EDGES:
            break
        waits = pairs.select(F.col("b").alias("ord")).distinct()
        stays = materialize(pairs.select(F.col("a").alias("ord")).distinct().join(waits, "ord", "left_anti"))
        met = materialize(pairs.join(stays, F.col("a") == F.col("ord"), "left_semi"))
        drop = materialize(verified(full, met, threshold).select(F.col("b").alias("ord")).distinct())
        lost.append(drop)
        rest = pairs.join(stays.withColumnRenamed("ord", "a"), "a", "left_anti").join(drop.withColumnRenamed("ord", "b"), "b", "left_anti")
        pairs = materialize(rest.join(drop.withColumnRenamed("ord", "a"), "a", "left_anti").select("a", "b"))
    last = settled(materialize(verified(full, pairs, threshold)))
    gone = reduce(DataFrame.unionAll, lost + ([last] if last else [])).distinct()
    return rows.select("ord").join(gone.withColumn("_gone", F.lit(True)), "ord", "left").select("ord", F.col("_gone").isNull().alias("keep"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; partial aggregation, no window."""
    others = [c for c in rows.columns if c != key]
    least = rows.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("r"))
    return least.select(key, "r.*").select(rows.columns)


def best_of(rows: DataFrame, keys: Sequence[str], score: str, order: str) -> DataFrame:
    """The row of the highest score of each key, then of the lowest order."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.col(score), -F.col(order))).alias("r"))
    return best.select(*keys, "r.*").select(rows.columns)

