"""1. Byte-level BPE encoding and decoding, long texts by tree concatenation.

A text longer than ``leaf_chars`` is cut into leaves at fixed places, with no regard to words. Spark tasks encode the
leaves in parallel; then rounds of pairwise joins climb the tree. A join re-encodes a window around the cut and doubles
it until the window's first and last tokens are exactly the tokens that both sides already have there. A sequence of
tokens is the encoding of its text if each two neighbours are (neighbours come from the left side, the window or the
right side, each of which is an encoding), so the joined sequence is the encoding of the joined text.

Rows: null and empty texts have no tokens; repeated rows are encoded each; an empty table gives an empty table; columns
other than the id and the text are ignored. The text of the special token is that token, wherever it stands.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.text import AT_END, map_arrow, texts

#: Code points in a leaf of the tree.
LEAF_CHARS = 32_768
#: Tokens on either side of a cut that the first window takes in.
WINDOW = 32
#: Tokens at each end of a window that have to agree.
AGREE = 8
#: Bounds of the cache of encoded words in a worker: entries, and code points of a word that is kept.
CACHE_WORDS, CACHE_CHARS = 300_000, 40
#: A blank that begins a pre-token; what tells that a text has other blanks.
UNIT, IRREGULAR = re.compile(r" (?=\S)"), re.compile(r" (?:\s|$)")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: those of Latin-1 as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file of the tokenizers library. Words are looked up in a bounded cache; what is new is merged by
    tiktoken from the same ranks, a vocabulary's ids being in the order of its merges."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_of_char()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self._merge = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.bytes_of = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = token
        self._cache: dict[str, bytes] = {}

    def forget(self) -> None:
        """The cached words; the next task fills the cache anew."""
        self._cache = {}

    def _merged(self, text: str) -> bytes:
        return array("I", self._merge.encode(text, allowed_special="all")).tobytes()

    def _plain(self, text: str) -> bytes:
        return array("I", self._merge.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit numbers.

        A blank before anything but white space always begins a pre-token, so what lies between two such blanks can be
        encoded by itself and is looked up as a whole."""
        if any(s in text for s in self.special):
            return self._merged(text)
        first, *rest = UNIT.split(text) if IRREGULAR.search(text) else text.split(" ")
        cache = self._cache
        head = self._plain(first) if first else b""
        try:
            return head + b"".join([cache[u] for u in rest])
        except KeyError:
            pass
        out = [head]
        for u in rest:
            ids = cache.get(u)
            if ids is None:
                ids = self._plain(" " + u)
                if len(u) <= CACHE_CHARS and len(cache) < CACHE_WORDS:
                    cache[u] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def join(self, left: bytes, right: bytes) -> bytes:
        """The ids of the joined text from the ids of its two parts."""
        a, b = np.frombuffer(left, "<u4"), np.frombuffer(right, "<u4")
        if not len(a) or not len(b):
            return left + right
        width = WINDOW
        while True:
            i, j = max(0, len(a) - width), min(len(b), width)
            while i and self._inside(a[i]):  # a window begins and ends with whole code points
                i -= 1
            while j < len(b) and self._inside(b[j]):
                j += 1
            window = np.frombuffer(self.encode(self.decode(a[i:].tobytes() + b[:j].tobytes()).decode()), "<u4")
            begins = not i or np.array_equal(window[:AGREE], a[i : i + AGREE])
            ends = j == len(b) or np.array_equal(window[-AGREE:], b[j - AGREE : j])
            if begins and ends and (len(window) >= 2 * AGREE or (not i and j == len(b))):
                return a[:i].tobytes() + window.tobytes() + b[j:].tobytes()
            width *= 2

    def _inside(self, token: int) -> bool:
        """Whether the token begins within a code point."""
        return self.bytes_of[token][0] & 0xC0 == 0x80


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _forget_words() -> None:
    for found in _LOADED.values():
        found.forget()


AT_END.append(_forget_words)


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


Made = Callable[[Vocabulary, list[bytes]], dict]


def _as_ids(vocab: Vocabulary, found: list[bytes]) -> dict:
    return {"ids": pa.array(found, pa.binary())}


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, made: Made = _as_ids, schema: str = "ids binary") -> DataFrame:
    """(doc_id, ids): the ids of each whole text, as binary of little-endian unsigned 32-bit numbers, or the columns that
    ``made`` makes of them in the same task. Tasks hold the two parts of one join at most, besides their batch of texts."""
    whole = texts(docs, id_col, text_col)

    def leaves() -> Callable:
        vocab = vocabulary(path)

        def each(batch: pa.RecordBatch) -> dict:
            ids, found = _columns(batch, "doc_id", "text")
            return {"doc_id": pa.array(ids, pa.int64())} | made(vocab, [vocab.encode(t) for t in found])

        return each

    short = map_arrow(whole.where(F.length("text") <= leaf_chars), leaves, f"doc_id long, {schema}")
    long = whole.where(F.length("text") > leaf_chars)
    if (longest := long.agg(F.max(F.length("text"))).first()[0]) is None:
        return short
    cut = long.select("doc_id", F.expr("uuid()").alias("row"), "text").select(
        "doc_id", "row", F.posexplode(F.expr(f"transform(sequence(0, (length(text) - 1) div {leaf_chars}), i -> substring(text, int(i) * {leaf_chars} + 1, {leaf_chars}))")).alias("at", "text")
    )

    def parts() -> Callable:
        vocab = vocabulary(path)

        def each(batch: pa.RecordBatch) -> dict:
            ids, rows, at, found = _columns(batch, "doc_id", "row", "at", "text")
            return {"doc_id": pa.array(ids, pa.int64()), "row": pa.array(rows), "at": pa.array(at, pa.int32()), "ids": pa.array([vocab.encode(t) for t in found], pa.binary())}

        return each

    level = map_arrow(cut.repartition("row", "at"), parts, "doc_id long, row string, at int, ids binary")
    levels = ((longest - 1) // leaf_chars).bit_length()

    def joins(last: bool) -> Callable:
        def make() -> Callable:
            vocab = vocabulary(path)

            def each(batch: pa.RecordBatch) -> dict:
                ids, rows, at, sides = _columns(batch, "doc_id", "row", "at2", "sides")
                joined = [s[0]["ids"] if len(s) == 1 else vocab.join(*(x["ids"] for x in sorted(s, key=lambda x: x["at"]))) for s in sides]
                if last:
                    return {"doc_id": pa.array(ids, pa.int64())} | made(vocab, joined)
                return {"doc_id": pa.array(ids, pa.int64()), "row": pa.array(rows), "at": pa.array(at, pa.int32()), "ids": pa.array(joined, pa.binary())}

            return each

        return make

    for i in range(1, levels + 1):
        pairs = level.groupBy("doc_id", "row", F.expr("at div 2").cast("int").alias("at2")).agg(F.collect_list(F.struct("at", "ids")).alias("sides"))
        level = map_arrow(pairs, joins(i == levels), f"doc_id long, {schema}" if i == levels else "doc_id long, row string, at int, ids binary", rows=32)
    return short.unionByName(level)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def make() -> Callable:
        vocab = vocabulary(path)

        def each(batch: pa.RecordBatch) -> dict:
            ids, found = _columns(batch, "doc_id", "ids")
            return {"doc_id": pa.array(ids, pa.int64()), "text": pa.array([vocab.decode(x).decode(errors="replace") for x in found])}

        return each

    return map_arrow(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids are encoded and decoded again, and only hashes are kept."""

    def made(vocab: Vocabulary, found: list[bytes]) -> dict:
        lists = [np.frombuffer(x, "<u4").tolist() for x in found]
        return {
            "n_tokens": pa.array([len(x) for x in lists], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in lists]),
            "decoded_sha256": pa.array([hashlib.sha256(vocab.decode(x).decode(errors="replace").encode()).hexdigest() for x in found]),
        }

    return encode(docs, path, id_col, text_col, leaf_chars, made, "n_tokens long, ids_sha256 string, decoded_sha256 string")
