"""5. Removal of repeated passages by distributed prefix doubling.

A position's rank at an offset is the name of the bytes from there up to the offset: equal ranks, equal bytes. Rounds sort
the (position, rank) pairs, drop positions whose rank is unique, and rank the rest by pairs of ranks at a growing offset,
until the threshold of ``span`` bytes is passed:

1. Ranks at ``span / 2`` bytes. Not every position has to take part: a string of ``span`` bytes always holds a position
   whose rank is the least of the ``span / 2 + 1`` that fit into it, and any other occurrence of the string holds the same
   one. Only these anchors are sorted, about two in a hundred positions; an anchor of unique rank lies in no repeat.
2. Pairs of an anchor's rank and the rank of its whole surroundings, up to where the strings that hold it reach. Equal
   pairs: every string around these anchors is repeated. Anchors that are equal in rank but not in the pair lie where
   repeats end; one of each kind goes on.
3. There, every position is ranked, by the pair of its rank at ``span / 2`` and the one ``span / 2`` further on: its rank at
   ``span``. What is not unique is repeated.

Texts are kept in blocks of about a megabyte. A block sends its distinct ranks, in ranges of the rank, to the tasks that
sort them, and gets a byte for each in return; a passage that is frequent in a block is sent once, so even the most
frequent one gives a task a rank for each block at most. Ranks are 64-bit names by polynomial hashing (pairs of them in
rounds 2 and 3).

Rows: null and empty texts have no bytes; a repeated row is an occurrence of its own (so all of its strings are repeated);
texts under ``span`` bytes lose nothing; an empty table gives an empty table; columns besides id and text are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.text import map_arrow, release, texts
from lexforge.plans.tables import materialize

#: Length from which a repeated string is removed.
SPAN = 200
#: Bytes of text in a block, bytes of text for each task that sorts ranks, and positions that are hashed at a time.
BLOCK, SORTED, STEP = 1 << 20, 8 << 20, 1 << 17
#: Multipliers of the two polynomials, and the seed of their byte values.
BASES, SEED = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 5

SHARED, ENDS, SENT = 1, 2, 4


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@functools.cache
def _tables(n: int, name: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a polynomial: values of the bytes, and powers of its base and of the inverse."""
    values = np.random.default_rng(SEED + name).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    inverse = pow(BASES[name], -1, 1 << 64)
    return values, np.cumprod(np.full(n, BASES[name], np.uint64)), np.cumprod(np.full(n, inverse, np.uint64))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if reach < width else x


class Block:
    """Some texts, one after the other."""

    def __init__(self, data: bytes, sizes: np.ndarray, span: int):
        self.bytes = np.frombuffer(data, np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.span, self.half = span, span // 2
        self.width = span - self.half + 1  # positions of a half that fit into a span

    def _around(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each position in [lo, hi): where its text begins and ends."""
        first, last = np.searchsorted(self.bounds, lo, "right") - 1, np.searchsorted(self.bounds, hi, "left")
        edges = np.clip(self.bounds[first : last + 1], lo, hi)
        return np.repeat(self.bounds[first:last], np.diff(edges)), np.repeat(self.bounds[first + 1 : last + 1], np.diff(edges))

    def _sums(self, lo: int, hi: int, name: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of a polynomial over [lo, hi), and what brings a part of it to its own start."""
        values, powers, inverses = _tables(STEP + 4 * self.span, name)
        part = values[self.bytes[lo:hi]] * powers[: hi - lo]
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)]), inverses

    def anchors(self) -> tuple[np.ndarray, ...]:
        """(position, from, to, rank, rank of the surroundings) of each anchor; [from, to) is what strings around it reach."""
        span, half, width, size = self.span, self.half, self.width, len(self.bytes)
        found = []
        for base in range(0, size, STEP):
            lo, hi = max(0, base - width + 1), min(size, base + STEP + span)
            if hi - lo < span:
                continue
            begin, end = self._around(lo, hi)
            sums, inverses = self._sums(lo, hi)
            others, other_inverses = self._sums(lo, hi, 1)
            n = hi - lo
            rank = mix((sums[half:] - sums[:-half]) * inverses[: n - half + 1])
            least = _least(rank, width)  # for strings that start at each position
            place = np.arange(lo, lo + len(least))
            least[end[: len(least)] - place < span] = 0
            pad = np.zeros(width - 1, np.uint64)
            anchor = ~_least(~np.concatenate([pad, least, pad]), width) == rank
            at = np.flatnonzero(anchor & (rank > 0))
            at = at[(at + lo >= base) & (at + lo < base + STEP)]
            left = np.maximum(at - (width - 1), begin[at] - lo)
            right = np.minimum(at + span, end[at] - lo)
            around = mix((others[right] - others[left]) * other_inverses[left]) + ((right - left) * 1024 + at - left).astype(np.uint64)
            found.append((at + lo, left + lo, right + lo, mix(rank[at] * np.uint64(BASES[0])), around))  # anchors' ranks are small: spread again
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))

    def ranks(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At ``span``, of the given ascending positions: the pair of the ranks at half of it, by two polynomials."""
        out = np.zeros((2, len(places)), np.uint64)
        for base in range(0, len(self.bytes), STEP):
            first, last = np.searchsorted(places, [base, base + STEP])
            if first == last:
                continue
            at = places[first:last] - base
            for name in (0, 1):
                sums, inverses = self._sums(base, min(len(self.bytes), base + STEP + self.span), name)
                near = mix((sums[at + self.half] - sums[at]) * inverses[at])
                further = mix((sums[at + self.span] - sums[at + self.half]) * inverses[at + self.half])
                out[name, first:last] = mix(near * np.uint64(0xD6E8FEB86659FD93) + further)
        return out[0], out[1]


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of columns: the first of each distinct row, in ascending order of the rows; the number of each row's
    distinct one; whether that is there more than once."""
    n = len(columns[0])
    order = np.lexsort(columns[::-1])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]  # lexsort is stable
    return first, number, np.bincount(number, minlength=len(first)) > 1


class Anchors:
    """A block's anchors and their distinct pairs of ranks."""

    def __init__(self, block: Block):
        self.at, self.left, self.right, rank, around = block.anchors()
        self.first, self.number, self.twice = _distinct(rank, around)
        self.rank, self.around = rank[self.first], around[self.first]

    def ends(self, block: Block, answer: np.ndarray) -> np.ndarray:
        """The positions of round 3."""
        chosen = self.first[(answer & ENDS > 0) & (answer & SENT > 0)]
        edges = np.zeros(len(block.bytes) + 1, np.int32)
        np.add.at(edges, self.left[chosen], 1)
        np.add.at(edges, self.right[chosen] - block.span + 1, -1)
        return np.flatnonzero(np.cumsum(edges)[:-1] > 0)


def _messages(batch: int, ranges: int, twice: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(range, block, payload) of ascending distinct ranks."""
    part = ((columns[0] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    edges = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(part)], strict=True):
        if hi > lo:
            yield int(part[lo]), batch, b"".join([*(c[lo:hi].tobytes() for c in columns), twice[lo:hi].tobytes()])


def _answer(payloads: pd.DataFrame, ends: bool, columns: int = 2) -> pd.DataFrame:
    """For each rank of each block: whether it (both columns) is elsewhere, too; with ``ends`` also whether repeats end there,
    as other ranks share the first column and are not all repeated, and whether this block goes on for it."""
    payloads = payloads.sort_values("batch", kind="stable")
    sizes = np.array([len(p) // (8 * columns + 1) for p in payloads["payload"]])
    ranks = [np.concatenate([np.frombuffer(p, np.uint64, n, 8 * n * i) for p, n in zip(payloads["payload"], sizes, strict=True)]) for i in range(columns)]
    twice = np.concatenate([np.frombuffer(p, bool, n, 8 * n * columns) for p, n in zip(payloads["payload"], sizes, strict=True)])
    first, number, several = _distinct(*ranks)
    shared = several.copy()
    shared[number[twice]] = True
    out = shared[number].astype(np.uint8) * SHARED
    if ends:
        _, group, _ = _distinct(ranks[0][first])
        kinds = np.bincount(group)
        alone = np.bincount(group, weights=~shared) > 0
        out |= ((kinds > 1) & alone)[group][number].astype(np.uint8) * ENDS
        sends = np.zeros(len(number), bool)
        sends[first] = True
        out |= sends.astype(np.uint8) * SENT
    edges = np.concatenate([[0], np.cumsum(sizes)])
    return pd.DataFrame({"batch": payloads["batch"].to_numpy(), "range": payloads["range"].to_numpy(), "answer": [out[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]})


def _asked(messages: DataFrame, ends: bool, name: str) -> DataFrame:
    """(batch, answers in the order of the ranges) of (range, batch, payload)."""

    def sort(payloads: pd.DataFrame) -> pd.DataFrame:
        out = _answer(payloads, ends)
        release()
        return out

    answered = messages.groupBy("range").applyInPandas(sort, "batch long, range int, answer binary")
    return answered.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("range", "answer"))).alias(name))


def _joined(answers: pa.Scalar) -> np.ndarray:
    return np.frombuffer(b"".join(x["answer"] for x in answers.as_py() or []), np.uint8)


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(batch, ids, sizes, data, n_bytes) of (id, text): whole texts in blocks, compressed; written once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        held: list[bytes] = []
        room = 0
        kind = pa.int64()

        def out() -> pa.RecordBatch:
            data = b"".join(held)
            sizes = np.array([len(x) for x in held], np.int64)
            columns = {"batch": pa.array([number], pa.int64()), "ids": pa.array([ids], pa.list_(kind)), "sizes": pa.array([sizes.tobytes()], pa.binary())}
            return pa.RecordBatch.from_pydict(columns | {"data": pa.array([zstandard.compress(data, 3)], pa.binary()), "n_bytes": pa.array([len(data)], pa.int64())})

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                held.append(text.as_py().encode())
                room += len(held[-1])
                if room >= size:
                    yield out()
                    ids, held, room, number = [], [], 0, number + 1
        if ids:
            yield out()
        held.clear()
        release()

    return materialize(docs.mapInArrow(pack, f"batch long, ids array<{docs.schema[0].dataType.simpleString()}>, sizes binary, data binary, n_bytes long"))


def _block(row: dict, span: int) -> Block:
    return Block(zstandard.decompress(row["data"].as_py()), np.frombuffer(row["sizes"].as_py(), np.int64), span)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}


def remove_repeats(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, points: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every byte goes that is covered by a string of ``span`` bytes that also
    starts elsewhere, in this or another text; ``kept`` is the rest as binary. With ``carry``, doc_id is a struct of those
    columns. With ``points``, a code point that loses a byte is not in ``kept`` either; the numbers stay the same."""
    if span % 2:
        raise ValueError("the span must be even")
    found = docs.select(F.struct(*carry).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) if carry else texts(docs, id_col, text_col).withColumnRenamed("doc_id", "id")
    whole = blocks(found)
    id_type = found.schema["id"].dataType.simpleString()
    ranges = max(1, -(-(whole.agg(F.sum("n_bytes")).first()[0] or 0) // SORTED))
    kind = [("range", pa.int32()), ("batch", pa.int64()), ("payload", pa.binary())]

    def told(found: list[tuple]) -> dict:
        return {n: pa.array([x[i] for x in found], t) for i, (n, t) in enumerate(kind)}

    def first() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            found = []
            for row in _rows(batch):
                a = Anchors(_block(row, span))
                found += _messages(row["batch"].as_py(), ranges, a.twice, a.rank, a.around)
            return told(found)

        return each

    def second() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            found = []
            for row in _rows(batch):
                block = _block(row, span)
                ranks = block.ranks(Anchors(block).ends(block, _joined(row["pairs"])))
                one, _, twice = _distinct(*ranks)
                found += _messages(row["batch"].as_py(), ranges, twice, *(r[one] for r in ranks))
            return told(found)

        return each

    def last() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
            kind = batch.schema.field("ids").type.value_type
            for row in _rows(batch):
                block = _block(row, span)
                a = Anchors(block)
                pairs = _joined(row["pairs"])
                places = a.ends(block, pairs)
                _, number, _ = _distinct(*block.ranks(places))
                starts = places[_joined(row["strings"])[number] & SHARED > 0]
                edges = np.zeros(len(block.bytes) + 1, np.int32)
                repeated = (pairs[a.number] & SHARED) > 0
                for places_, step in ((a.left[repeated], 1), (a.right[repeated], -1), (starts, 1), (starts + span, -1)):
                    np.add.at(edges, places_, step)
                gone = np.cumsum(edges)[:-1] > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                bounds = block.bounds
                inner = bounds[:-1][np.diff(bounds) > 0]
                begins[inner] = gone[inner]
                removed, spans = (np.concatenate([[0], np.cumsum(x)])[bounds] for x in (gone, begins))
                out["doc_id"] += row["ids"].as_py()
                out["n_bytes"] += np.diff(bounds).tolist()
                out["n_removed"] += np.diff(removed).tolist()
                out["n_spans"] += np.diff(spans).tolist()
                if points and len(gone):
                    lead = (block.bytes & 0xC0) != 0x80
                    lead[inner] = True
                    at = np.flatnonzero(lead)
                    gone = np.repeat(np.logical_or.reduceat(gone, at), np.diff(np.append(at, len(gone))))
                    removed = np.concatenate([[0], np.cumsum(gone)])[bounds]
                rest = block.bytes[~gone].tobytes()
                cuts = (bounds - removed).tolist()
                out["kept"] += [rest[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            return {n: pa.array(x, kind if n == "doc_id" else pa.binary() if n == "kept" else pa.int64()) for n, x in out.items()}

        return each

    data = whole.select("batch", "sizes", "data")
    pairs = materialize(_asked(map_arrow(data, first, "range int, batch long, payload binary", rows=4), True, "pairs"))
    further = map_arrow(data.join(pairs, "batch", "left"), second, "range int, batch long, payload binary", rows=4)
    strings = _asked(further, False, "strings")
    both = whole.select("batch", "ids", "sizes", "data").join(pairs, "batch", "left").join(strings, "batch", "left")
    return map_arrow(both, last, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary", rows=4)
