"""6. Language-model scores by online logistic mixing of hashed-context bit predictors.

A token is coded as the path to it in a binary tree (a Huffman tree over the training counts of the ``VOCABULARY`` most
frequent tokens and one escape for the rest). Every node of the path is a bit that four predictors guess: one knows the node
alone, the others the node with a hashed context (the word before; the two words before; the last very frequent word,
which tells the language). Their log-odds are mixed by weights that a gate picks (how deep the node is, and which contexts
have been seen). Gated weights are fitted on every training row: each of its bits is guessed by tables that lack that one bit, and
Spark counts how often which odds meet which bit, in ``LEVELS`` steps of each predictor; the optimum on these counts is one,
whatever the start (a fit on a few rows). On top of the weights, each ``SEGMENT`` tokens of a text refine a correction online, after each
token, by the gradient of its bits. Contexts reach over segments. An escaped token is one of the rest by its training count
plus one. So every token has a probability, and these sum to one over the known tokens and one unknown. Bits per byte follow
from the score.

Spark counts all training tokens, then codes every text to its symbols once; tables, weights and scores are had from these. The
nodes of four levels of the tree lie side by side in a context's table, so that a path meets few lines of memory. The context tables grow with them up to a stated size, are filled by each task from all its
training rows and summed up in ranges of slots. What the driver holds is bounded by VOCABULARY, MOST_BITS, CELLS, SAMPLE_ROWS and
SAMPLE_CHARS. Counts of rare words never go to it: rare words of a text are joined to their counts.

Rows: a null or empty text is its end token; a null id has no fold and is scored only; repeated rows count and are scored
each; an empty training set leaves N = V = 0 and every token unknown; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.labelled import by_hash, fold
from lexforge.llm.text import map_arrow, release, words_of
from lexforge.plans.tables import materialize

#: Tokens with a place of their own in the tree, at most, and bytes of such a word; most frequent words that tell the language.
VOCABULARY, WORD_BYTES, FREQUENT = 1 << 17, 256, 64
#: Training tokens to a slot of a context's table, and bounds of the number of slots, as powers of two.
TOKENS_TO_A_SLOT, LEAST_BITS, MOST_BITS = 64, 18, 22
#: Rows that the gated weights' start is fitted on, about, and characters of each at most; all rows give the weights.
SAMPLE_ROWS, SAMPLE_CHARS = 120, 200_000
#: Tokens that share a correction, its rate, what each bit count starts from, ranges of slots that are summed apart, and
#: tables of counts that are added up at a time.
SEGMENT, RATE, PRIOR, RANGES, FAN_IN = 1024, 0.02, 0.4, 32, 32
#: Tokens whose steps are worked on at a time, so that arrays of these stay in a core's cache.
AT_A_TIME = 16384
CONTEXTS, DEPTHS = 3, 4
#: Log-odds that a predictor's are rounded to, when what the weights are fitted on is counted, and where they meet; zero is apart.
_OVER = np.array([0.2, 0.5, 0.9, 1.5, 2.3, 3.3, 4.8, 7.0], np.float32)
LEVELS = np.concatenate([-_OVER[::-1], np.zeros(1, np.float32), _OVER])
_EDGES = np.concatenate([(LEVELS[:7] + LEVELS[1:8]) / 2, np.array([-1e-6, 1e-6], np.float32), (LEVELS[9:16] + LEVELS[10:]) / 2])
ZERO, STEPS = len(_OVER), len(LEVELS)
#: Cells of these counts by (depth, node's level, bit, contexts' levels), up to a multiple of RANGES.
CELLS = -(-DEPTHS * STEPS * 2 * STEPS**CONTEXTS // RANGES) * RANGES
#: Tokens that a task counts at least where there are more tasks than cores: it writes a whole table, however few it has read.
TASK_TOKENS = 40_000_000
#: The end of a text as a token: no word is empty.
END = b""


#: Levels of the tree whose nodes share a hash but for its last GROUP bits: a context has them side by side in its table.
GROUP = 4
#: A step of a path: hash of its node, log-odds of a one there, bucket of its depth, and the bit that the path takes.
STEP = np.dtype([("node", "<u4"), ("odds", "<f2"), ("depth", "i1"), ("bit", "i1")])
#: All numbers of two bytes, as numpy is slow to widen them.
HALVES = np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float32)


@dataclass
class Tree:
    """Paths of all symbols, one after the other; symbol i of ``words``, then the escape."""

    words: list[bytes]
    start: np.ndarray
    length: np.ndarray
    steps: np.ndarray  # of the paths, as STEP: one look-up gets all of a step

    @staticmethod
    def of(words: list[bytes], counts: list[int], rest: int) -> Tree:
        weights = [*counts, max(1, rest)]
        leaves = len(weights)
        parent, odds = array("i", [-1]) * (2 * leaves), array("f", [0.0]) * (2 * leaves)
        side = bytearray(2 * leaves)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        node = leaves
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = node
            side[j], odds[node] = 1, math.log((b + PRIOR) / (a + PRIOR))
            heapq.heappush(heap, (a + b, node))
            node += 1
        lengths, nodes, bits = array("i"), array("i"), bytearray()
        for i in range(leaves):
            path = []
            while parent[i] >= 0:
                path.append((parent[i], side[i]))
                i = parent[i]
            nodes.extend(n for n, _ in reversed(path))
            bits.extend(b for _, b in reversed(path))
            lengths.append(len(path))
        n, length = np.frombuffer(nodes, np.int32).astype(np.int64), np.array(lengths, np.int32)
        start = np.cumsum(length, dtype=np.int32) - length
        steps = np.empty(len(n), STEP)
        at = np.arange(len(n))
        level = at - np.repeat(start, length)
        steps["odds"] = np.frombuffer(odds, np.float32)[n]
        steps["depth"] = np.minimum(level // 3, DEPTHS - 1)
        steps["bit"] = np.frombuffer(bits, np.int8)
        within = level % GROUP
        place = (1 << within) - 1  # of a node in its group: by the bits that lead to it from the group's first
        for back in range(1, GROUP):
            place += np.where(within >= back, steps["bit"][np.maximum(at - back, 0)].astype(np.int64) << (back - 1), 0)
        steps["node"] = (n[at - within] * 0x9E3779B1 & 0xFFFFFFFF) >> GROUP << GROUP | place
        return Tree(words, start, length, steps)


def context_hashes(x: np.ndarray, first: np.ndarray, escape: int) -> list[np.ndarray]:
    """For each token of texts laid end to end (``first`` marks their first tokens): the hashes of its contexts."""
    n = len(x)
    at = np.arange(n)
    begin = np.maximum.accumulate(np.where(first, at, 0))
    one = np.where(at > begin, x[np.maximum(at - 1, 0)], escape + 1)
    two = np.where(at > begin + 1, x[np.maximum(at - 2, 0)], escape + 1)
    seen = np.maximum.accumulate(np.where(x < FREQUENT, at, -1))
    last = np.concatenate([[-1], seen[:-1]])
    usual = np.where(last >= begin, x[np.maximum(last, 0)], escape + 1)

    def spread(v: np.ndarray, salt: int) -> np.ndarray:
        v = (v.astype(np.uint64) + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
        return (v >> np.uint64(32)).astype(np.uint32)

    return [spread(one, 1), spread(one * (1 << 20) + two, 2), spread(usual, 3)]


def parted(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the nodes of a group share, and their places in it."""
    place = nodes & np.uint32((1 << GROUP) - 1)
    return nodes ^ place, place


def spots(context: np.ndarray, lengths: np.ndarray, groups: np.ndarray, places: np.ndarray, bits: int, wide: int = 0) -> np.ndarray:
    """The slots, of 2 ** bits, of each step: a group's are within 2 ** GROUP, each elsewhere for another context. With slots of
    2 ** wide numbers, ``places`` are those of the numbers."""
    found = np.repeat(context, lengths)
    found ^= groups
    found *= np.uint32(0x85EBCA6B)
    found >>= np.uint32(32 - bits)
    if wide:
        found <<= np.uint32(wide)
    found ^= places
    return found.astype(np.intp)


def slots(context: np.ndarray, lengths: np.ndarray, nodes: np.ndarray, bits: int) -> np.ndarray:
    """spots() of nodes."""
    return spots(context, lengths, *parted(nodes), bits)


def bits_for(tokens: int) -> int:
    """A table grows with the corpus, up to what a worker can hold."""
    return min(MOST_BITS, max(LEAST_BITS, (max(1, tokens) // TOKENS_TO_A_SLOT).bit_length()))


def places(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the steps of the paths of the tokens are, one after the other, and the paths' lengths."""
    lengths = tree.length[x]
    ends = np.cumsum(lengths, dtype=np.intp)
    where = np.repeat(tree.start[x] - (ends - lengths), lengths)
    where += np.arange(len(where))
    return where, lengths


def events(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the paths of the tokens, one after the other, and the paths' lengths."""
    where, lengths = places(tree, x)
    return np.take(tree.steps.view(np.int64), where, mode="clip").view(STEP), lengths


class Symbols:
    """Texts as symbols of a tree."""

    def __init__(self, tree: Tree):
        self.place = {w: i for i, w in enumerate(tree.words)}
        self.escape = len(tree.words)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all tokens, and tokens of each text."""
        parts = [x for x, _ in map(self.each, texts)]
        return np.concatenate([np.empty(0, np.int64), *parts]), np.array([len(x) for x in parts], np.int64)

    def each(self, text: str) -> tuple[np.ndarray, dict[bytes, int]]:
        """Symbols of a text's tokens, and how often it has which words that are none."""
        words = words_of(text)
        words.append(END)
        found = np.fromiter(map(self.place.get, words, repeat(self.escape)), np.int64, len(words))
        return found, Counter([words[i] for i in np.flatnonzero(found == self.escape)])


def equal_weights() -> np.ndarray:
    """By gate and predictor."""
    return np.tile([0.25] * (CONTEXTS + 1) + [0.0], (4 * DEPTHS, 1))


@dataclass
class Model:
    tree: Tree
    counts: np.ndarray  # of the words, in training
    tokens: int
    distinct: int
    tables: np.ndarray  # log-odds by context and slot
    weights: np.ndarray  # by gate and predictor

    def predictors(self, x: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of all predictors (the last is a constant) for each bit, its gate and value, and the paths' lengths."""
        steps, lengths = events(self.tree, x)
        nodes = parted(steps["node"])
        s = np.empty((CONTEXTS + 2, len(steps)), np.float32)
        bits = self.tables.shape[1].bit_length() - 1
        for k, h in enumerate(hashes):
            np.take(self.tables[k], spots(h, lengths, *nodes, bits), out=s[k], mode="clip")
        np.take(HALVES, steps["odds"].view(np.uint16), out=s[CONTEXTS], mode="clip")
        s[-1] = 0.3
        gate = steps["depth"] * np.int8(4) + (s[0] != 0).view(np.int8) * np.int8(2) + (s[1] != 0).view(np.int8)
        return s, gate, steps["bit"].astype(np.float32), lengths

    def mixed(self, s: np.ndarray, gate: np.ndarray) -> np.ndarray:
        columns, gate = np.ascontiguousarray(self.weights.T, np.float32), gate.astype(np.intp)
        out, part = np.zeros(len(gate), np.float32), np.empty(len(gate), np.float32)
        for k in range(len(s)):
            np.take(columns[k], gate, out=part, mode="clip")
            part *= s[k]
            out += part
        return out

    def fit(self, x: np.ndarray, hashes: list[np.ndarray], steps: int = 60, rate: float = 0.5) -> None:
        """The gated weights, by full gradients over the sample's bits."""
        s, gate, y, _ = self.predictors(x, hashes)
        n = np.bincount(gate, minlength=len(self.weights)) + 50.0
        moved = np.zeros_like(self.weights)
        for _ in range(steps):
            error = y - 1 / (1 + np.exp(-np.clip(self.mixed(s, gate), -20, 20)))
            grad = np.stack([np.bincount(gate, error * s[k], len(self.weights)) for k in range(len(s))], axis=1) / n[:, None]
            moved = 0.8 * moved + rate * 0.2 * grad
            self.weights = self.weights + moved

    def fit_cells(self, cells: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> None:
        """The gated weights, by Newton's steps over all training bits, counted by cell. A ridge around equal weights makes the
        optimum one; it is what a gate without bits has."""
        at = np.flatnonzero(cells)
        n, rest, levels = cells[at].astype(np.float64), at, []
        for _ in range(CONTEXTS):
            rest, level = np.divmod(rest, STEPS)
            levels.insert(0, level)
        rest, y = np.divmod(rest, 2)
        depth, node = np.divmod(rest, STEPS)
        s = np.stack([*(LEVELS[x] for x in levels), LEVELS[node], np.full(len(at), 0.3)], axis=1).astype(np.float64)
        gate = depth * 4 + (levels[0] != ZERO) * 2 + (levels[1] != ZERO)
        weights = equal_weights()
        for g in np.unique(gate):
            own = gate == g
            a, m, b, w, prior = s[own], n[own], y[own], self.weights[g], weights[g].copy()
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
                slope = a.T @ (m * (b - p)) - ridge * (w - prior)
                step = np.linalg.solve((a * (m * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), slope)
                w = w + step * min(1.0, 1 / max(1e-9, float(np.abs(step).max())))
                if np.abs(step).max() < 1e-6:
                    break
            weights[g] = w
        self.weights = weights

    def token_logs(self, x: np.ndarray, sizes: np.ndarray, escape: int, rate: float = RATE) -> np.ndarray:
        """The natural logarithm of each token's probability, given those before it in its text; symbols of all texts, one
        after the other, and tokens of each."""
        if not len(self.tree.steps):  # nothing was learned from: all are the escape
            return np.zeros(len(x))
        ends = np.cumsum(sizes)
        first = np.zeros(len(x), bool)
        first[ends - sizes] = True
        hashes = context_hashes(x, first, escape)
        pieces = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(sizes)), pieces)
        lane = (ends - sizes)[text] + SEGMENT * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        span = np.minimum(SEGMENT, ends[text] - lane)
        order = np.argsort(-span, kind="stable")
        lane, span = lane[order], span[order]
        active = len(span) - np.searchsorted(span[::-1], np.arange(1, SEGMENT + 1))  # lanes that have a token j
        correction = np.zeros((CONTEXTS, len(lane)), np.float32)  # of the contexts' weights
        logs = np.zeros(len(x))
        j0 = 0
        while j0 < SEGMENT and active[j0]:  # features of some tokens of each lane at a time
            js = [j for j in range(j0, min(j0 + max(1, AT_A_TIME // int(active[j0])), SEGMENT)) if active[j]]
            j0 += max(1, AT_A_TIME // int(active[j0]))
            at = np.concatenate([lane[: active[j]] + j for j in js])
            s, gate, y, lengths = self.predictors(x[at], [h[at] for h in hashes])
            z = self.mixed(s, gate)
            sign = y
            sign *= 2
            sign -= 1
            edges = np.concatenate([[0], np.cumsum(lengths)])
            done = 0
            for j in js:
                n = active[j]
                own = lengths[done : done + n]
                a, b = edges[done], edges[done + n]
                heads = edges[done : done + n] - a
                part, right = s[:CONTEXTS, a:b], sign[a:b]
                p = z[a:b]
                for k in range(CONTEXTS):
                    moved = np.repeat(correction[k, :n], own)
                    moved *= part[k]
                    p += moved
                p *= right
                np.negative(p, out=p)
                np.exp(p, out=p)
                p += 1
                np.reciprocal(p, out=p)
                np.maximum(p, np.float32(1e-6), out=p)
                np.minimum(p, np.float32(1 - 1e-6), out=p)  # of the bit that is there
                logs[lane[:n] + j] = np.add.reduceat(np.log(p), heads)
                error = np.subtract(1, p, out=p)
                error *= right
                error *= np.float32(rate)
                for k in range(CONTEXTS):
                    np.multiply(part[k], error, out=part[k])
                    correction[k, :n] += np.add.reduceat(part[k], heads)
                done += n
        return logs

    def log_odds(self, texts: list[str], symbols: Symbols) -> tuple[np.ndarray, ...]:
        """log_odds_of() of texts."""
        return self.log_odds_of(*symbols.of(texts))

    def log_odds_of(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each text, by its symbols: tokens, known frequent tokens, rare tokens, log10 of the base's and the model's
        probability of all but the choice among rare words."""
        logs = self.token_logs(x, sizes, len(self.tree.words))
        counted = np.append(self.counts, -1)[x]
        base = np.where(counted >= 0, np.log10(np.maximum(counted, 0) + 1.0) - math.log10(self.tokens + self.distinct + 1), 0)
        number = np.repeat(np.arange(len(sizes)), sizes)
        known = np.bincount(number, counted > 0, len(sizes))
        return sizes, known, np.bincount(number, counted < 0, len(sizes)), np.bincount(number, base, len(sizes)), np.bincount(number, logs / math.log(10), len(sizes))


def count_tokens(rows: DataFrame) -> DataFrame:
    """(word, n) of all texts; the end of a text is the empty word."""

    def make() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            counts = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
            counts[END] += batch.num_rows
            return {"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())}

        return each

    return map_arrow(rows.select("text"), make, "word binary, n long", rows=4096).groupBy("word").agg(F.sum("n").alias("n"))


def add_contexts(counts: np.ndarray, tree: Tree, x: np.ndarray, sizes: np.ndarray, times: int = 1) -> None:
    """Add the bits of some texts' symbols, each so many times, to counts by (context, slot and bit)."""
    bits = (counts.shape[1] // 2).bit_length() - 1
    hashes = context_hashes(x, firsts(sizes), len(tree.words))
    for at in range(0, len(x), AT_A_TIME):
        steps, lengths = events(tree, x[at : at + AT_A_TIME])
        groups, numbers = paired(steps)
        added = np.full(len(steps), times, np.int32)  # faster than a number
        for k in range(CONTEXTS):
            np.add.at(counts[k], spots(hashes[k][at : at + AT_A_TIME], lengths, groups, numbers, bits, 1), added)


def paired(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """parted() where a slot has a number for each bit."""
    groups, numbers = parted(steps["node"])
    numbers <<= np.uint32(1)
    numbers |= steps["bit"].view(np.uint8)
    return groups, numbers


def count_contexts(counts: np.ndarray, tree: Tree, symbols: Symbols, texts: list[str], times: int = 1) -> None:
    """add_contexts() of texts."""
    add_contexts(counts, tree, *symbols.of(texts), times)


def firsts(sizes: np.ndarray) -> np.ndarray:
    """Of texts laid end to end: whether a token is a text's first."""
    first = np.zeros(int(sizes.sum()), bool)
    first[np.cumsum(sizes) - sizes] = True
    return first


def level_of(odds: np.ndarray) -> np.ndarray:
    return np.searchsorted(_EDGES, odds).astype(np.uint8)


def left_out(counts: np.ndarray) -> np.ndarray:
    """By (context, slot and bit): the level of the log-odds of all other bits in the slot."""
    out = np.empty(counts.shape, np.uint8)
    for k in range(CONTEXTS):
        for at in range(0, counts.shape[1], 1 << 20):
            zeros, ones = counts[k, at : at + (1 << 20)].reshape(-1, 2).astype(np.float32).T
            out[k, at : at + (1 << 20) : 2] = level_of(np.log((ones + PRIOR) / (np.maximum(zeros - 1, 0) + PRIOR)))
            out[k, at + 1 : at + (1 << 20) : 2] = level_of(np.log((np.maximum(ones - 1, 0) + PRIOR) / (zeros + PRIOR)))
    return out


def add_cells(cells: np.ndarray, tree: Tree, levels: np.ndarray, x: np.ndarray, sizes: np.ndarray) -> None:
    """Add how often which levels meet which bit in some texts' symbols, each bit guessed without itself."""
    bits = (levels.shape[1] // 2).bit_length() - 1
    hashes = context_hashes(x, firsts(sizes), len(tree.words))
    code = (tree.steps["depth"].astype(np.int32) * STEPS + level_of(tree.steps["odds"].astype(np.float32))) * 2 + tree.steps["bit"]
    found = []
    for at in range(0, len(x), AT_A_TIME):
        where, lengths = places(tree, x[at : at + AT_A_TIME])
        groups, numbers = paired(np.take(tree.steps.view(np.int64), where, mode="clip").view(STEP))
        cell = np.take(code, where, mode="clip")
        for k in range(CONTEXTS):
            cell *= np.int32(STEPS)
            cell += np.take(levels[k], spots(hashes[k][at : at + AT_A_TIME], lengths, groups, numbers, bits, 1), mode="clip")
        found.append(cell)
        if len(found) == 8 or at + AT_A_TIME >= len(x):
            cells += np.bincount(np.concatenate(found), minlength=len(cells))
            found.clear()


def odds_of(counts: np.ndarray) -> np.ndarray:
    """Log-odds of a one by (context, slot)."""
    pairs = counts.reshape(CONTEXTS, -1, 2).astype(np.float32) + np.float32(PRIOR)
    return np.log(pairs[:, :, 1] / pairs[:, :, 0])


def coded(rows: DataFrame, tree: Tree) -> DataFrame:
    """The texts' symbols, as bytes of ints, their bytes and their words that are no symbols, with the other columns."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def make() -> Callable:
        symbols = Symbols(shared.value)

        def each(batch: pa.RecordBatch) -> dict:
            texts = batch.column(0).to_pylist()
            parts = [symbols.each(t) for t in texts]
            flat = [x for _, rare in parts for x in rare.items()]
            edges = pa.array(np.cumsum([0, *(len(rare) for _, rare in parts)]).astype(np.int32))
            found = pa.StructArray.from_arrays([pa.array([w for w, _ in flat], pa.binary()), pa.array([n for _, n in flat], pa.int32())], ["word", "n"])
            own = {"symbols": pa.array([x.astype(np.int32).tobytes() for x, _ in parts], pa.binary()), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "others": pa.ListArray.from_arrays(edges, found)}
            return own | {f.name: batch.column(i + 1) for i, f in enumerate(kept)}

        return each

    schema = ", ".join(["symbols binary, n_bytes long, others array<struct<word:binary,n:int>>", *(f"{f.name} {f.dataType.simpleString()}" for f in kept)])
    return map_arrow(rows.select("text", *(f.name for f in kept)), make, schema)


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts, from their bytes: all, one after the other, and tokens of each text."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.int32).astype(np.int64), np.array([len(p) // 4 for p in parts], np.int64)


def _summed(rows: DataFrame, tokens: int, shape: tuple[int, int], kind: type, task: Callable[[], tuple[np.ndarray, Callable]]) -> np.ndarray:
    """An array that is summed over all rows of symbols, of about ``tokens`` tokens. Each task fills one of its own (``task`` gives
    it, and what adds symbols and sizes to it); ranges of columns are summed apart, in a tree. Splits of the input are put
    together into tasks, as each shuffles an array of its own."""
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-tokens // TASK_TOKENS))
    rows = rows.select("symbols").coalesce(tasks)
    height, width = shape[0], shape[1] // RANGES

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, add = task()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                add(*laid_out(batch.column(0)[i : i + 512]))
        if counts.any():
            part = TaskContext.get().partitionId()
            for r in range(RANGES):
                own = np.ascontiguousarray(counts[:, width * r : width * (r + 1)])
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "range": pa.array([r], pa.int32()), "counts": pa.array([zstandard.compress(own.tobytes(), 3)], pa.binary())})
        del counts, add
        release()

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((height, width), np.int64)
        for part in parts["counts"]:
            total += np.frombuffer(zstandard.decompress(part), kind).reshape(total.shape)
        summed = np.minimum(total, np.iinfo(kind).max).astype(kind)
        return pd.DataFrame({"part": parts["part"].iloc[:1] // FAN_IN, "range": parts["range"].iloc[:1], "counts": [zstandard.compress(summed.tobytes(), 3)]})

    schema = "part int, range int, counts binary"
    left = rows.rdd.getNumPartitions()
    found = rows.mapInArrow(fill, schema)
    while left > 1:
        found = found.groupBy("range", F.expr(f"part div {FAN_IN}")).applyInPandas(add, schema)
        left = -(-left // FAN_IN)
    counts = np.zeros(shape, kind)
    for r in found.collect():  # as many numbers as the array has
        counts[:, width * r["range"] : width * (r["range"] + 1)] += np.frombuffer(zstandard.decompress(r["counts"]), kind).reshape(height, width)
    return counts


def context_counts(rows: DataFrame, tree: Tree, bits: int, tokens: int = 0) -> np.ndarray:
    """Counts by (context, slot and bit) from all rows, of texts or their symbols."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def task() -> tuple[np.ndarray, Callable]:
        counts = np.zeros((CONTEXTS, 2 << bits), np.int32)
        return counts, lambda x, sizes: add_contexts(counts, shared.value, x, sizes)

    rows = rows if "symbols" in rows.columns else coded(rows.select("text"), tree)
    return _summed(rows, tokens, (CONTEXTS, 2 << bits), np.int32, task)


def cell_counts(rows: DataFrame, tree: Tree, counts: np.ndarray, tokens: int = 0) -> np.ndarray:
    """What the weights are fitted on: counts by cell from all rows of symbols, with the counts of all contexts."""
    shared = rows.sparkSession.sparkContext.broadcast((tree, left_out(counts)))

    def task() -> tuple[np.ndarray, Callable]:
        cells = np.zeros((1, CELLS), np.int64)
        return cells, lambda x, sizes: add_cells(cells[0], *shared.value, x, sizes)

    found = _summed(rows, tokens, (1, CELLS), np.int64, task)[0]
    shared.unpersist()
    return found


def least_count(counts: DataFrame, words: int) -> int:
    """The lowest count that no more than so many words reach. Counts are binned (exactly below 1,024, sixteen bins to a
    doubling above), so the driver gets some two thousand numbers."""
    bins = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.ceil(F.pow(F.lit(2.0), F.floor(F.log2("n") * 16) / 16)).cast("long"))
    total = 0
    least = 1 << 62
    for r in sorted(counts.groupBy(bins.alias("b")).count().collect(), key=lambda r: -r["b"]):
        total += r["count"]
        if total > words:
            break
        least = r["b"]
    return least


@dataclass
class Vocabulary:
    """Training tokens and distinct ones, training texts, the tree and its words' counts."""

    tokens: int
    distinct: int
    texts: int
    tree: Tree
    counts: np.ndarray

    @staticmethod
    def of(counts: DataFrame) -> Vocabulary:
        tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        top = counts.where((F.col("n") >= least_count(counts, VOCABULARY - 1)) & (F.length("word") <= WORD_BYTES)).toArrow()
        words, numbers = top["word"].to_pylist(), top["n"].to_pylist()
        order = sorted(range(len(words)), key=lambda i: (-numbers[i], words[i]))
        words, numbers = [words[i] for i in order], [numbers[i] for i in order]
        ends = (counts.where(F.length("word") == 0).first() or {"n": 0})["n"]  # as many as texts
        if ends and END not in words:
            words.append(END)
            numbers.append(ends)
        return Vocabulary(tokens, distinct, ends, Tree.of(words, numbers, tokens - sum(numbers)), np.array(numbers, np.int64))

    def sampled(self) -> Column:
        """Whether the start of the weights is fitted on a training text: by the whole row, so that about so many distinct rows
        are collected, however often each is there."""
        return (F.length("text") <= SAMPLE_CHARS) & by_hash(F.xxhash64("doc_id", "text"), SAMPLE_ROWS, self.texts)


def train(rows: DataFrame, counts: DataFrame) -> Model:
    """From the training rows (doc_id, text) and the counts of their tokens: tables and weights learn from all of them."""
    vocabulary = Vocabulary.of(counts)
    return learned(rows, materialize(coded(rows.select("text", vocabulary.sampled().alias("sampled")), vocabulary.tree)), vocabulary)


def learned(rows: DataFrame, known: DataFrame, vocabulary: Vocabulary) -> Model:
    """train(), from the training rows, (symbols, sampled) of them, and the vocabulary."""
    tree, tokens = vocabulary.tree, vocabulary.tokens
    counts = context_counts(known.where("not sampled"), tree, bits_for(tokens), tokens)
    model = Model(tree, vocabulary.counts, tokens, vocabulary.distinct, odds_of(counts), equal_weights())
    fitted = rows.where(vocabulary.sampled()).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")).orderBy("doc_id", "text").collect()
    if fitted and tree.words:
        symbols = Symbols(tree)
        x, sizes = symbols.of([r["text"] for r in fitted])
        model.fit(x, context_hashes(x, firsts(sizes), len(tree.words)))
        for r in fitted:  # now that the weights' start is fitted on them, they are learned from, too; counts end where an int does
            room = ((1 << 31) - 1 - int(counts.max())) // max(1, len(events(tree, symbols.of([r["text"]])[0])[0]))
            count_contexts(counts, tree, symbols, [r["text"]], max(1, min(r["n"], room)))
        model.tables = odds_of(counts)
    model.fit_cells(cell_counts(known, tree, counts, tokens))
    return model


def scores(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte); ``learns``, over doc_id, tells the
    training rows. Texts are coded to symbols once; tables, weights and scores are had from these."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    training = rows.where(learns)
    counts = materialize(count_tokens(training))
    vocabulary = Vocabulary.of(counts)
    keyed = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), F.coalesce(learns, F.lit(False)).alias("learns"), vocabulary.sampled().alias("sampled"))
    known = materialize(coded(keyed, vocabulary.tree))
    model = learned(training, known.where("learns"), vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge() -> Callable:
        model = shared.value

        def each(batch: pa.RecordBatch) -> dict:
            sizes, frequent, rare, base, own = model.log_odds_of(*laid_out(batch.column(0)))
            found = {"n_tokens": pa.array(sizes), "known": pa.array(frequent.astype(np.int64)), "rare": pa.array(rare.astype(np.int64)), "base": pa.array(base), "own": pa.array(own)}
            return found | {name: batch.column(i + 1) for i, name in enumerate(("doc_id", "row", "n_bytes"))}

        return each

    n, v = model.tokens, model.distinct
    rest_n, rest_v = n - int(model.counts.sum()), v - len(model.counts)
    judged = materialize(map_arrow(known.select("symbols", "doc_id", "row", "n_bytes"), judge, "n_tokens long, known long, rare long, base double, own double, doc_id long, row long, n_bytes long", rows=2048))
    rare = known.select("row", F.inline("others"))
    weighed = rare.join(counts.withColumnRenamed("n", "c"), "word", "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"))
    by_row = weighed.groupBy("row").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("found"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"))
    joined = judged.join(by_row, "row", "left")
    once = F.coalesce(F.col("rare") / F.col("all"), F.lit(0.0))  # a repeated row's words were counted with each repeat
    logs, found = F.coalesce("logs", F.lit(0.0)) * once, F.coalesce("found", F.lit(0)) * once
    out = joined.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.round(found)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("rare") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("own") + logs - F.col("rare") * math.log10(rest_n + rest_v + 1)).alias("score"),
        "n_bytes",
    )
    return out.withColumn("bits_per_byte", -F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))).drop("n_bytes")


def held_out_scores(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """scores() with every fold but one in training, and held_out."""
    found = scores(docs, fold(F.col("doc_id"), folds) != held)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
